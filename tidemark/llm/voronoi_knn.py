"""Exact top-k search by inner product: a Voronoi join of queries and data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Vectors that the cells are built around: a sample of this size at most.
PIVOTS = 32
#: Rows of a block of data and of a block of queries that meet in one task.
DATA_BLOCK = 4096
QUERY_BLOCK = 1024
_SEED = 17
#: Up to here a double holds every integer.
_EXACT = float(1 << 53)


def integer_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    """(id, v) with floor(scale * x) of each component, x as double.

    Rows whose id is null, whose vector is null or empty, or that hold a null or non-finite component take no part.
    Rows equal in id and vector are one. Components beyond 2^62 / scale are outside the contract.
    """
    x = F.col(vector_column).cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    usable = vectors.filter(F.col(id_column).isNotNull() & (F.size(x) > 0)).filter(good)
    scaled = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c).cast("long"))
    return usable.select(F.col(id_column).alias("id"), scaled.alias("v")).distinct()


def _matrix(rows, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros, which leaves inner products as they are."""
    out = np.zeros((len(rows), width), np.float64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def _cells(pivots: np.ndarray):
    """Adds to (id, v) the nearest pivot's number, the distance to it and the number of components."""
    squares = (pivots ** 2).sum(1)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            width = max(pivots.shape[1], max(map(len, frame["v"])))
            x = _matrix(frame["v"], width)
            p = np.zeros((len(pivots), width))
            p[:, :pivots.shape[1]] = pivots
            far = np.sqrt(np.maximum((x ** 2).sum(1)[:, None] - 2 * x @ p.T + squares, 0))
            cell = far.argmin(1)
            yield frame.assign(cell=cell.astype(np.int32), far=far[np.arange(len(frame)), cell])

    return assign


def _needed(pivots: np.ndarray, cells: list[tuple[int, float, int, list[float]]], k: int):
    """For each query the cells that may hold one of its ``k`` best.

    By Cauchy and Schwarz, the product of a query q with a vector at distance d from pivot p differs from
    q.p by |q| d at most. The summaries of the cells, their radius and k + 1 smallest distances, so give
    a score that k vectors other than the query surely reach, and the best score each cell can offer.
    """
    numbers = np.array([c[0] for c in cells])
    radius = np.array([c[1] for c in cells])
    near = [(i, d) for i, c in enumerate(cells) for d in c[3]]
    near_cell, near_far = np.array([i for i, _ in near], int), np.array([d for _, d in near])

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            width = max(pivots.shape[1], max(map(len, frame["v"])))
            q = _matrix(frame["v"], width)
            p = np.zeros((len(cells), width))
            p[:, :pivots.shape[1]] = pivots[numbers]
            length = np.sqrt((q ** 2).sum(1))[:, None]
            middle = q @ p.T
            slack = 1e-9 * (np.abs(middle) + length * (radius + 1) + 1)
            best = middle + length * radius + slack
            sure = np.sort((middle - slack)[:, near_cell] - length * near_far, axis=1)
            # One of the vectors counted may be the query itself.
            floor = sure[:, -(k + 1)] if sure.shape[1] > k else np.full(len(q), -np.inf)
            row, column = np.nonzero(best >= floor[:, None])
            yield pd.DataFrame({"query_id": frame["id"].to_numpy()[row], "q": frame["v"].to_numpy()[row],
                                "cell": numbers[column].astype(np.int32)})

    return ask


def _summaries(placed: DataFrame, k: int) -> DataFrame:
    """(cell, radius, n, near), one row per cell: its size, largest distance and k + 1 smallest ones.

    The smallest are found in two steps, so that no task holds the distances of a whole cell.
    """
    least = Window.partitionBy("cell", "slot").orderBy("far")
    few = (
        placed.select("cell", "far", F.pmod(F.xxhash64("id"), F.lit(64)).alias("slot"))
        .withColumn("nth", F.row_number().over(least)).filter(F.col("nth") <= k + 1)
        .groupBy("cell").agg(F.slice(F.array_sort(F.collect_list("far")), 1, k + 1).alias("near"))
    )
    return placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).join(few, "cell")


def _solve(k: int):
    def solve(key, data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(data) or not len(queries):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})
        width = max(max(map(len, data["v"])), max(map(len, queries["q"])))
        data = data.sort_values("id", kind="stable")
        x, q = _matrix(data["v"], width), _matrix(queries["q"], width)
        if width * np.abs(x).max() * np.abs(q).max() >= _EXACT:
            x, q = (np.array([list(r) + [0] * (width - len(r)) for r in rows], np.int64) for rows in (data["v"], queries["q"]))
        scores = q @ x.T
        ids, asked = data["id"].to_numpy(), queries["query_id"].to_numpy()
        out = []
        for i in range(len(q)):
            own = scores[i].astype(np.int64)
            others = np.flatnonzero(ids != asked[i])
            # Ids ascend, so a stable sort puts the smaller id first among equal scores.
            if len(others) > k:
                least = np.partition(own[others], len(others) - k)[len(others) - k]
                others = others[own[others] >= least]
            best = others[np.argsort(-own[others], kind="stable")[:k]]
            out.append(pd.DataFrame({"query_id": np.full(len(best), asked[i]), "vec_id": ids[best], "score": own[best]}))
        return pd.concat(out)

    return solve


def top_k(vectors: DataFrame, queries: Callable[[Column], Column], k: int = 5, id_column: str = "vec_id",
          vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for each row whose id satisfies ``queries``.

    The score is the inner product of the integer vectors (``integer_vectors`` says which rows take part);
    ties go to the smaller id, and a row never finds its own id. Vectors of unequal length count as filled
    up with zeros. With fewer than k other rows, all are returned.

    Data go to the cell of their nearest pivot (at most ``PIVOTS``, the same sample each time); cells are
    dealt in blocks of about ``DATA_BLOCK`` rows, so a cell may hold any share of them. Only pivots and one
    summary per cell reach the driver. A query is copied to the cells that the bounds leave; those that
    are copied to a block meet it in blocks of ``QUERY_BLOCK``, and the k best per block are merged.
    """
    spark = vectors.sparkSession
    data = materialize(integer_vectors(vectors, id_column, vector_column, scale), "vectors")
    drawn = data.orderBy(F.xxhash64("id", F.lit(_SEED)), "id", "v").limit(PIVOTS).select("v").collect()
    schema = "query_id long, rank int, vec_id long, score long"
    if not drawn:
        return spark.createDataFrame([], schema)
    pivots = np.unique(_matrix([r["v"] for r in drawn], max(len(r["v"]) for r in drawn)), axis=0)
    placed = materialize(data.mapInPandas(_cells(pivots), "id long, v array<long>, cell int, far double"), "cells")
    cells = [(r["cell"], r["radius"], r["n"], r["near"]) for r in _summaries(placed, k).collect()]
    blocks = spark.createDataFrame([(c, max(1, -(-n // DATA_BLOCK))) for c, _, n, _ in cells], "cell int, blocks int")
    asked = data.filter(queries(F.col("id"))).select("id", "v")
    copies = asked.mapInPandas(_needed(pivots, cells, k), "query_id long, q array<long>, cell int")
    n_queries = asked.count()
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    copies = materialize(copies.withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")), "copies")
    wanted = copies.select("cell", "query_block").distinct().join(F.broadcast(blocks), "cell")
    meets = wanted.select("cell", "query_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = placed.join(F.broadcast(blocks), "cell").select(
        "id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    x = dealt.join(meets, ["cell", "block"]).select("id", "v", "cell", "block", "query_block")
    keys = ["cell", "block", "query_block"]
    theirs = [f"of_{c}" for c in keys]
    q = copies.join(meets, ["cell", "query_block"]).select("query_id", "q", *[F.col(c).alias(f"of_{c}") for c in keys])
    local = x.groupBy(*keys).cogroup(q.groupBy(*theirs)).applyInPandas(_solve(k), "query_id long, vec_id long, score long")
    order = F.struct((-F.col("score")).alias("down"), "vec_id")
    best = local.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"),
        (-F.col("b.down")).alias("score"))
