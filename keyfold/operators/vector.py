"""Vectors by name: validated upsert, lookup, and exact cosine top-k with a threshold."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from keyfold.functions.expressions import cosine, norm, parse_vector

#: Most results of a search.
MOST = 128
#: Queries and vectors that meet in one task.
QUERY_BLOCK, VECTOR_CHUNK = 8_192, 16_384
#: The same for searches by threshold, which keep no k best; and scores that such a task holds at once.
LSH_BLOCK, LSH_CHUNK, SCORES = 65_536, 32_768, 1 << 22
#: Tables of the approximate search, the width of their buckets, how many of the pairs at the threshold itself share enough
#: buckets, and vectors whose buckets are compared at once.
LSH_TABLES, LSH_WIDTH, LSH_FOUND, LSH_TILE = 256, 1.5, 0.95, 8_192


def validated(rows: DataFrame) -> DataFrame:
    """(…, dim, text) with ``vector``, ``norm`` and ``reply``: OK, or why the vector is refused."""
    parsed = parse_vector(F.col("text"))
    rows = rows.withColumn("vector", parsed).withColumn("norm", norm(F.col("vector")))
    good = F.col("vector").isNotNull() & (F.size("vector") == F.col("dim")) & (F.col("norm") > 0)
    reply = F.when(F.coalesce(F.col("dim"), F.lit(0)) <= 0, "ERR invalid dim").when(F.coalesce(good, F.lit(False)), "OK").otherwise("ERR vector set failed")
    return rows.withColumn("reply", reply)


def latest(vectors: DataFrame) -> DataFrame:
    """Of each question the row with the highest seq."""
    row = F.struct(*[c for c in vectors.columns if c != "question"])
    return vectors.groupBy("question").agg(F.max_by(row, "seq").alias("r")).select("question", "r.*")


def stored(vectors: DataFrame) -> DataFrame:
    """(question, answer, vector) with dim and norm, without vectors that would be refused."""
    rows = vectors.withColumn("dim", F.size("vector")).withColumn("norm", norm(F.col("vector")))
    return rows.filter(F.col("norm") > 0)


def search(vectors: DataFrame, query: list[float], k: int | None = None, threshold: float | None = None) -> DataFrame:
    """The k highest cosines with one query, at least the threshold; ties by question. Wrong lengths never match."""
    if k is not None and k <= 0:
        raise ValueError("ERR invalid vector search args")
    q = F.array(*(F.lit(float(x)) for x in query))
    q_norm = sum(float(x) ** 2 for x in query) ** 0.5
    rows = vectors.filter(F.size("vector") == len(query)).select("question", "answer", cosine(F.col("vector"), F.col("norm"), q, F.lit(q_norm)).alias("score"))
    rows = rows.filter(F.col("score").isNotNull())
    if threshold is not None:
        rows = rows.filter(F.col("score") >= threshold)
    if k is None:
        return rows
    return rows.orderBy(F.desc("score"), "question").limit(min(k, MOST))


def nearest(vectors: DataFrame, query: list[float], threshold: float) -> DataFrame:
    """The best match, or no row."""
    return search(vectors, query, 1, threshold)


def get(vectors: DataFrame, question: str) -> DataFrame:
    """The vector stored under a question: (question, answer), or no row."""
    return vectors.filter(F.col("question") == question).select("question", "answer")


def get_many(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """``questions`` with the answer stored under each ``question``, or null."""
    named = vectors.select(F.col("question").alias("__question"), F.col("answer").alias("__answer"))
    joined = questions.drop("answer").join(named, questions["question"] == named["__question"], "left")
    return joined.withColumn("answer", F.col("__answer")).drop("__question", "__answer")


def _best(queries: pd.DataFrame, vectors: pd.DataFrame, k: int, threshold: float | None) -> pd.DataFrame:
    """Top k of a block's vectors for each of its queries. A matrix product finds those that may count; their scores are then
    summed alike wherever they stand, so that equal vectors have equal scores."""
    q, v = (np.stack(x.to_numpy()).astype(np.float64) for x in (queries["vector"], vectors["vector"]))
    q_norm, v_norm = queries["norm"].to_numpy(), vectors["norm"].to_numpy()
    out = []
    for at in range(0, len(q), 256):
        near = (q[at : at + 256] @ v.T) / np.outer(q_norm[at : at + 256], v_norm)
        k = min(k, near.shape[1])
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] - 1e-9
        if threshold is not None:
            least = np.maximum(least, threshold - 1e-9)
        i, j = np.nonzero(near >= least[:, None])
        i += at
        score = (q[i] * v[j]).sum(1) / (q_norm[i] * v_norm[j])
        found = pd.DataFrame({"query_id": queries["id"].to_numpy()[i], "question": vectors["id"].to_numpy()[j], "answer": vectors["answer"].to_numpy()[j], "score": score})
        found = found if threshold is None else found[found["score"] >= threshold]
        out.append(found.sort_values(["query_id", "score", "question"], ascending=[True, False, True]).groupby("query_id").head(k))
    return pd.concat(out)


def search_many(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, block: int = QUERY_BLOCK, chunk: int = VECTOR_CHUNK) -> DataFrame:
    """Top k for each row of ``queries`` (query_id, q).

    Queries are dealt out to blocks and vectors to chunks of bounded size; each block meets each chunk in one task, which keeps
    its k best, and these are merged. Both tables are read once, whatever their sizes.
    """
    if k <= 0:
        raise ValueError("ERR invalid vector search args")
    k = min(k, MOST)
    asked = queries.select("query_id", F.col("q").alias("vector"), norm(F.col("q")).alias("norm")).filter("norm > 0")
    blocks, chunks = max(1, -(-asked.count() // block)), max(1, -(-vectors.count() // chunk))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    doubles = F.col("vector").cast("array<double>").alias("vector")
    left = asked.select(F.size("vector").alias("n"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("b"), numbers(chunks).alias("c"), F.col("query_id").alias("id"), doubles, "norm")
    right = vectors.filter("norm > 0").select(F.size("vector").alias("n"), numbers(blocks).alias("b"), F.pmod(F.xxhash64("question"), F.lit(chunks)).cast("int").alias("c"), F.col("question").alias("id"), "answer", doubles, "norm")
    schema = asked.select("query_id").limit(0).select("query_id", F.lit("").alias("question"), F.lit("").alias("answer"), F.lit(0.0).alias("score")).schema

    arrow = to_arrow_schema(schema)

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return arrow.empty_table()
        return pa.Table.from_pandas(_best(queries.to_pandas(), vectors.to_pandas(), k, threshold), schema=arrow, preserve_index=False)

    found = left.groupBy("n", "b", "c").cogroup(right.groupBy("n", "b", "c")).applyInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "question")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _rows(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """Vectors of ``n`` components as rows."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)


def _projections(n: int, tables: int) -> np.ndarray:
    """A random unit vector for each table; ``n`` of them at a time are orthogonal, which counts nearness more evenly."""
    group = min(n, tables)
    rows = np.random.default_rng(42).standard_normal((-(-tables // group), n, group))
    return np.linalg.qr(rows)[0].transpose(0, 2, 1).reshape(-1, n)[:tables]


def _buckets(unit: np.ndarray, projections: np.ndarray, width: float) -> np.ndarray:
    """Each table's bucket for each unit vector, (table, vector), from 0; what is not a number is in bucket zero."""
    half = math.ceil(1 / width)
    return np.clip(np.nan_to_num(np.floor(projections @ unit.T / width)), -half, half - 1).astype(np.int64) + half


def _sketches(unit: np.ndarray, projections: np.ndarray, width: float) -> np.ndarray:
    """The bits of all tables' buckets, (bit of the number, 64 tables, vector)."""
    bits, words = (2 * math.ceil(1 / width) - 1).bit_length(), -(-len(projections) // 64)
    out = np.zeros((bits, words, len(unit)), np.uint64)
    for at in range(0, len(unit), LSH_TILE):
        buckets = _buckets(unit[at : at + LSH_TILE], projections, width)
        for bit in range(bits):
            row = np.zeros((buckets.shape[1], 64 * words), np.uint8)
            row[:, : len(buckets)] = (buckets >> bit & 1).T
            out[bit, :, at : at + LSH_TILE] = np.packbits(row, axis=1).view(np.uint64).T
    return out


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many tables two sketches have different buckets."""
    count = 0
    for word in range(a.shape[1]):
        differ = a[0, word] ^ b[0, word]
        for bit in range(1, len(a)):
            differ |= a[bit, word] ^ b[bit, word]
        count = count + np.bitwise_count(differ).astype(np.uint16)
    return count


def _most_differing(projections: np.ndarray, threshold: float, width: float) -> int:
    """In how many tables candidates may differ: ``LSH_FOUND`` of random pairs whose cosine is the threshold itself do not differ
    in more. Nearer pairs differ in fewer, and as the projections are random this holds whatever the vectors. One bucket at
    least is shared."""
    a, b = np.random.default_rng(43).standard_normal((2, 2_000, projections.shape[1]))
    a /= np.sqrt((a**2).sum(1, keepdims=True))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.sqrt((b**2).sum(1, keepdims=True)), 1e-300)
    cos = min(1.0, max(-1.0, threshold))
    near = cos * a + (1 - cos**2) ** 0.5 * b
    differ = _differing(_sketches(a, projections, width), _sketches(near, projections, width))
    return min(int(np.quantile(differ, LSH_FOUND, method="higher")), len(projections) - 1)


def _candidates(q: np.ndarray, q_norm: np.ndarray, v: np.ndarray, v_norm: np.ndarray, threshold: float, tables: int, width: float) -> Callable[[int, int], Iterator[tuple[int, np.ndarray]]]:
    """A function that yields, by tiles, each query of a range and the vectors that share buckets with it in enough tables. No score
    is looked at. What has no direction, as it is not a number or its norm is not, is a candidate of all."""
    lines = _projections(q.shape[1], tables)
    most = _most_differing(lines, threshold, width)
    of_q, of_v = q / q_norm[:, None], v / v_norm[:, None]
    odd_q, odd_v = (~(np.isfinite(norms) & np.isfinite(rows).all(1)) for rows, norms in ((of_q, q_norm), (of_v, v_norm)))
    of_q, of_v = _sketches(of_q, lines, width), _sketches(of_v, lines, width)

    def run(start: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
        for left in range(0, len(v), LSH_TILE):
            tile = slice(left, left + LSH_TILE)
            for i in range(start, end):
                share = _differing(of_q[:, :, i], of_v[:, :, tile]) <= (len(lines) if odd_q[i] else most)
                yield i, left + np.flatnonzero(share | odd_v[tile])

    return run


def _reached(q: np.ndarray, q_norm: np.ndarray, v: np.ndarray, v_norm: np.ndarray, threshold: float, tables: int, width: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, score) of a block's pairs that reach the threshold; with tables, of the candidates only, and no others are scored.
    A score that is not a number is above all others, as in an ordering."""
    candidates = _candidates(q, q_norm, v, v_norm, threshold, tables, width) if tables else None
    step = max(1, SCORES // len(v))
    for at in range(0, len(q), step):
        if candidates:
            near = []
            for a, j in candidates(at, min(at + step, len(q))):
                j = j[~(v.take(j, axis=0) @ q[a] / (q_norm[a] * v_norm[j]) < threshold - 1e-9)]
                near.append((np.full(len(j), a), j))
            i, j = (np.concatenate(x) for x in zip(*near))
        else:
            near = (q[at : at + step] @ v.T) / np.outer(q_norm[at : at + step], v_norm)
            i, j = np.nonzero(~(near < threshold - 1e-9))
            i += at
        score = (q[i] * v[j]).sum(1) / (q_norm[i] * v_norm[j])
        good = ~(score < threshold)
        yield i[good], j[good], score[good]


def _met(vectors: DataFrame, queries: DataFrame, threshold: float, tables: int, width: float, schema: str | StructType, of: Callable, block: int, chunk: int) -> DataFrame:
    """What ``of(queries, vectors, pairs)`` makes of each block of queries and chunk of vectors, of which each pair meets in one task.

    Vectors are sent once for each block and queries once for each chunk, however many tables there are; pairs are not sent.
    """
    asked = queries.select("query_id", "q", norm(F.col("q")).alias("q_norm")).filter("q_norm > 0")
    n_asked, n_stored = asked.count(), vectors.count()
    blocks, chunks = max(1, -(-n_asked // block)), max(1, -(-n_stored // chunk))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.size("q").alias("n"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("b"), numbers(chunks).alias("c"), "query_id", "q", "q_norm")
    right = vectors.filter("norm > 0").select(F.size("vector").alias("n"), numbers(blocks).alias("b"), F.pmod(F.xxhash64("question"), F.lit(chunks)).cast("int").alias("c"), "question", "answer", "vector", "norm")
    keys = ["n", "b", "c"]
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(declared)

    def run(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return arrow.empty_table()
        n = key[0].as_py()
        norms = (x.to_numpy() for x in (queries["q_norm"], vectors["norm"]))
        q_norm, v_norm = norms
        with np.errstate(invalid="ignore", over="ignore"):
            return of(queries, vectors, _reached(_rows(queries["q"], n), q_norm, _rows(vectors["vector"], n), v_norm, threshold, tables, width)).cast(arrow)

    parts = blocks * chunks
    return left.repartition(parts, *keys).groupBy(*keys).cogroup(right.repartition(parts, *keys).groupBy(*keys)).applyInArrow(run, declared)


def count_reaching(vectors: DataFrame, queries: DataFrame, threshold: float, tables: int = 0, width: float = LSH_WIDTH, block: int = LSH_BLOCK, chunk: int = LSH_CHUNK) -> DataFrame:
    """(n): how many pairs of a row of ``queries`` (query_id, q) and a vector of its length reach the threshold; with ``tables``, how many of them the approximate search finds."""

    def of(queries: pa.Table, vectors: pa.Table, pairs: Iterator) -> pa.Table:
        return pa.table({"n": [sum(len(i) for i, _, _ in pairs)]})

    counts = _met(vectors.withColumn("answer", F.lit(None).cast("string")), queries, threshold, tables, width, "n long", of, block, chunk)
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"))


def _near(vectors: DataFrame, queries: DataFrame, n: int, threshold: float, tables: int, width: float, block: int = LSH_BLOCK, chunk: int = LSH_CHUNK) -> DataFrame:
    """Pairs (query_id, question, answer, score) that enough random projections bring together and whose exact score reaches the threshold."""
    stored, asked = vectors.filter(F.size("vector") == n), queries.filter(F.size("q") == n)
    schema = asked.select("query_id").limit(0).select("query_id", F.lit("").alias("question"), F.lit("").alias("answer"), F.lit(0.0).alias("score")).schema

    def of(queries: pa.Table, vectors: pa.Table, pairs: Iterator) -> pa.Table:
        found = [pa.table([queries["query_id"].take(i), vectors["question"].take(j), vectors["answer"].take(j), pa.array(score)], names=["query_id", "question", "answer", "score"]) for i, j, score in ((pa.array(i), pa.array(j), s) for i, j, s in pairs)]
        return pa.concat_tables(found)

    return _met(stored, asked, threshold, tables, width, schema, of, block, chunk)


def search_lsh(vectors: DataFrame, query: list[float], k: int, threshold: float, tables: int = LSH_TABLES, width: float = LSH_WIDTH) -> DataFrame:
    """Approximate search: candidates share buckets of ``width`` on enough of ``tables`` random projections of unit vectors (``_most_differing``), and only they are scored, exactly."""
    one = vectors.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id int, q array<double>")
    rows = _near(vectors, one, len(query), threshold, tables, width).drop("query_id")
    return rows.orderBy(F.desc("score"), "question").limit(min(k, MOST))


def search_lsh_many(vectors: DataFrame, queries: DataFrame, n: int, threshold: float, tables: int = LSH_TABLES, width: float = LSH_WIDTH) -> DataFrame:
    """(query_id, question, answer, score): approximately all vectors of ``n`` components that reach the threshold, for each row of ``queries`` (query_id, q)."""
    return _near(vectors, queries, n, threshold, tables, width)
