"""Exact top-k inner products by a Voronoi kNN join.

A bounded sample of vectors serves as pivots; every vector belongs to the cell of its nearest pivot. Each query is scored
against another bounded sample, and its k-th best score there is one that its k best are sure to reach. As
<q, x> = <q, p> + <q, x - p> is within |q| |x - p| of <q, p>, this says how far from each pivot a vector must lie to have
any chance with the query. Queries of neighbouring cells form groups of about ``block`` queries, so few queries do not
have the data copied for many small groups; per group and cell the least of its queries' distances is kept, and
only vectors beyond it are sent to the group. Groups are solved locally, cut into blocks of queries and
chunks of vectors of bounded size, and the k best of all chunks are merged.

How much is replicated depends on the vectors: where they form clusters most is pruned; where all directions are alike no bound
by distances prunes, and each group meets all data, which is then copied once for each ``block`` queries.

Scores are exact: vectors are integers (``floor(scale * x)``) and products are summed in 64-bit integers, or in
doubles where all sums are below 2 ** 53. Bounds are taken with a margin for rounding.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
without an id; vectors are compared with those of the same length only; rows that repeat both id and
vector are one row; a query never meets rows of its own id; ties go to smaller ids; fewer candidates than k give
fewer rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyfold.llm.shared import written

#: Pivots, each a vector on the driver and in every task; vectors that queries are scored against for their bounds.
PIVOTS, SAMPLE = 96, 4_096
#: Bounds of a task: queries of a block, vectors of a chunk.
BLOCK, CHUNK = 8_192, 16_384
#: Lengths of vectors that get pivots of their own.
SPACES = 8
SCORES = "query_id long, vec_id long, score long"
#: Relative margin on bounds that are computed in doubles.
SLACK = 1e-9


def quantized(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as long; null where the vector takes no part."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(good & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Cells:
    """The pivots of one vector length; finds cells."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.squares = pivots, (pivots * pivots).sum(1)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = np.argmin(self.squares - 2 * (x @ self.pivots.T), axis=1)
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(1))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of q with all of x."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best: highest score, then smallest id; columns of the row's own id are left out."""
    by_id = np.argsort(ids, kind="stable")
    scores, ids = scores[:, by_id], ids[by_id]
    valid = ids[None, :] != own[:, None]
    scores = np.where(valid, scores, np.iinfo(np.int64).min)
    k = min(k, scores.shape[1])
    cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    rows, cols = np.nonzero((scores >= cut[:, None]) & valid)
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < k], by_id[cols[rank < k]]


def _distinct(ids: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Places of rows that do not repeat both id and vector."""
    if len(np.unique(ids)) == len(ids):
        return np.arange(len(ids))
    return np.sort(np.unique(np.column_stack((ids, v)), axis=0, return_index=True)[1])


def _solver(k: int):
    """The k best of a task's vectors for each of its queries."""

    def solved(part: pd.DataFrame) -> pd.DataFrame:
        ask = part["ask"].to_numpy()
        queries, near = part[ask], part[~ask]
        if not len(queries) or not len(near):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, x = (np.stack(p["v"].to_numpy()) for p in (queries, near))
        own, ids = queries["id"].to_numpy(), near["id"].to_numpy()
        # rows that repeat id and vector have come to this task together
        one, two = _distinct(own, q), _distinct(ids, x)
        q, own, x, ids = q[one], own[one], x[two], ids[two]
        out = []
        for at in range(0, len(q), 256):
            scores = _products(q[at : at + 256], x)
            r, c = _best(scores, ids, own[at : at + 256], k)
            out.append(pd.DataFrame({"query_id": own[at : at + 256][r], "vec_id": ids[c], "score": scores[r, c]}))
        return pd.concat(out)

    return solved


def _hashed(rows: pd.DataFrame) -> np.ndarray:
    """A number for each row, the same for rows that repeat id and vector."""
    v = np.stack(rows["v"].to_numpy())
    odd = np.arange(1, 2 * v.shape[1], 2, dtype=np.int64)
    return rows["id"].to_numpy() * 1_000_003 + (v * odd).sum(1)


def _deal(hashed: np.ndarray, n: int) -> np.ndarray:
    return ((hashed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def _of_any_length(rows: DataFrame, k: int, block: int, chunk: int) -> DataFrame:
    """rows: (id, v, asks), vectors of rare lengths, all in one plan without pivots: each block of queries of a length meets each chunk of its vectors."""
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asks"), 1)).alias("asks")).first()
    blocks, chunks = max(1, -(-counts["asks"] // block)), max(1, -(-counts["n"] // chunk))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # rows that repeat id and vector go the same way
    mine = rows.filter("asks").select(F.size("v").alias("g"), F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("b"), numbers(chunks).alias("c"), F.lit(True).alias("ask"), "id", "v")
    data = rows.select(F.size("v").alias("g"), numbers(blocks).alias("b"), F.pmod(F.xxhash64("id", "v"), F.lit(chunks)).alias("c"), F.lit(False).alias("ask"), "id", "v")
    return mine.unionByName(data).groupBy("g", "b", "c").applyInPandas(_solver(k), SCORES)


def _groups(cells: Cells, queries: np.ndarray, block: int) -> np.ndarray:
    """The group of each cell: neighbouring cells, one after the other, until they have about ``block`` queries."""
    left, here, out, group, count = set(range(len(queries))), 0, np.zeros(len(queries), np.int64), 0, 0
    while left:
        left.discard(here)
        if count and count + queries[here] > block:
            group, count = group + 1, 0
        out[here], count = group, count + queries[here]
        rest = np.array(sorted(left), np.int64)
        if len(rest):
            here = int(rest[((cells.pivots[rest] - cells.pivots[here]) ** 2).sum(1).argmin()])
    return out


def _of_length(rows: DataFrame, k: int, pivots: int, block: int, chunk: int) -> DataFrame:
    """rows: (id, v, asks), all vectors of one length."""
    spark = rows.sparkSession
    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id", F.hash("v")).limit(max(pivots, SAMPLE)).toPandas()
    known, ids = np.stack(sample["v"].to_numpy()), sample["id"].to_numpy()
    own = _distinct(ids, known)
    cells = Cells(np.unique(known[:pivots].astype(np.float64), axis=0))
    shared = spark.sparkContext.broadcast((cells, known[own], ids[own]))
    m = len(cells.pivots)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch["cell"], batch["dist"] = shared.value[0].place(_matrix(batch["v"]))
                yield batch[["id", "v", "asks", "cell", "dist"]]

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each group's queries in a batch: per cell the least distance from the pivot that has a chance."""
        cells, known, ids = shared.value
        group = groups.value
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                exact = np.stack(part["v"].to_numpy())
                scores = np.where(ids[None, :] != part["id"].to_numpy()[:, None], _products(exact, known), np.iinfo(np.int64).min)
                sure = np.full(len(part), -np.inf)
                if scores.shape[1] >= k:
                    best = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                    sure[best > np.iinfo(np.int64).min] = best[best > np.iinfo(np.int64).min]
                v = exact.astype(np.float64)
                norm = np.sqrt((v * v).sum(1))
                near = v @ cells.pivots.T
                margin = SLACK * (np.abs(sure[np.isfinite(sure)]).max(initial=0) + np.abs(near).max() + norm.max() + 1)
                gap = sure[:, None] - near - margin
                need = np.where(norm[:, None] > 0, gap / np.maximum(norm, 1e-300)[:, None], np.where(gap <= 0, -np.inf, np.inf))
                need = np.where(need > 0, need * (1 - SLACK) - SLACK, -np.inf)
                of = group[part["cell"].to_numpy()]
                for g in np.unique(of):
                    yield pd.DataFrame({"g": g, "cell": np.arange(m), "need": need[of == g].min(0)})

    table = written(rows.mapInPandas(placed, "id long, v array<long>, asks boolean, cell int, dist double"), "cells")
    counts = table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("long")).alias("asks"), F.max("dist").alias("far")).toPandas()
    count, asks, far = np.zeros(m), np.zeros(m, np.int64), np.full(m, -1.0)
    count[counts["cell"]], asks[counts["cell"]], far[counts["cell"]] = counts["n"], counts["asks"], counts["far"]
    group = _groups(cells, asks, block)
    groups = spark.sparkContext.broadcast(group)
    needs = table.filter("asks").select("id", "v", "cell").mapInPandas(needed, "g int, cell int, need double").groupBy("g", "cell").agg(F.min("need").alias("need")).toPandas()
    least = np.full((group.max() + 1, m), np.inf)
    least[needs["g"], needs["cell"]] = needs["need"]
    least[:, far < 0] = np.inf
    least[least > far[None, :] * (1 + SLACK)] = np.inf
    expected = (np.where(np.isinf(least) & (least > 0), 0, 1) * count[None, :]).sum(1)
    blocks = -(-np.bincount(group, asks, len(least)).astype(np.int64) // block)
    chunks = np.maximum(1, -(-expected // chunk)).astype(np.int64)
    plan = spark.sparkContext.broadcast((least, blocks, chunks))

    def replicated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least, blocks, chunks = plan.value
        for batch in batches:
            if not len(batch):
                continue
            cell, dist, asked = (batch[c].to_numpy() for c in ("cell", "dist", "asks"))
            hashed = _hashed(batch)
            for g in np.flatnonzero(blocks):
                near, own = dist >= least[g, cell], (groups.value[cell] == g) & asked
                take, part = batch[near], _deal(hashed[near], chunks[g])
                for b in range(blocks[g]):
                    if len(take):
                        yield pd.DataFrame({"g": g, "b": b, "c": part, "ask": False, "id": take["id"], "v": take["v"]})
                mine = batch[own]
                for c in range(chunks[g]) if len(mine) else ():
                    yield pd.DataFrame({"g": g, "b": _deal(hashed[own] * 31 + 7, blocks[g]), "c": c, "ask": True, "id": mine["id"], "v": mine["v"]})

    dealt = table.mapInPandas(replicated, "g int, b long, c long, ask boolean, id long, v array<long>")
    return dealt.groupBy("g", "b", "c").applyInPandas(_solver(k), SCORES)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest products with all rows but its own."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = written(rows.filter("id IS NOT NULL AND v IS NOT NULL"), "vectors")
    # each of the lengths that are met most is a space of its own, the others are taken together
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(SPACES + 1).collect()
    lengths, found = [r["n"] for r in sizes[:SPACES]], None
    for n in lengths:
        part = _of_length(rows.filter(F.size("v") == n), k, pivots, block, chunk)
        found = part if found is None else found.unionByName(part)
    if len(sizes) > SPACES:
        found = found.unionByName(_of_any_length(rows.filter(~F.size("v").isin(lengths)), k, block, chunk))
    if found is None:
        found = rows.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
