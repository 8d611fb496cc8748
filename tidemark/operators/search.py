"""Top-k inner-product search over live rows.

Order is always (score descending, id ascending). One query is a plan of built-in expressions that
ends in TakeOrderedAndProject. Many queries are scored by matrix products of bounded size for each
Arrow batch, which hands on no more than k rows a query and, besides ties, none below the k best that
its task has seen; the final ranking limits groups before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from tidemark.operators import log
from tidemark.operators.filters import all_of


def inner_product(embedding: Column, query: Column | list[float]) -> Column:
    """In double precision."""
    other = F.array(*[F.lit(float(x)) for x in query]) if isinstance(query, list) else query
    return F.aggregate(F.zip_with(embedding, other, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, b: a + b)


def scored(rows: DataFrame, query: list[float], *filters: Column, more: tuple[str, ...] = ()) -> DataFrame:
    """``id``, ``score``, ``text``, ``metadata`` and ``version`` of the rows with a vector."""
    kept = rows.where(all_of(*filters)).where(F.col("embedding").isNotNull())
    return kept.select("id", inner_product(F.col("embedding"), query).alias("score"), "text", "metadata", F.col("lamport").alias("version"), *more)


def top_k(rows: DataFrame, query: list[float], k: int, *filters: Column) -> DataFrame:
    """The best ``k`` of live rows; ``k`` <= 0 gives nothing."""
    return scored(rows, query, *filters).orderBy(F.desc("score"), "id").limit(max(0, k))


def search(versions: DataFrame, query: list[float], k: int, *filters: Column, clock: int | None = None) -> DataFrame:
    """Top-k over a log, now or as of a clock. Filters see latest versions only."""
    return top_k(log.live(versions, clock), query, k, *filters)


#: Scores that a worker computes at once.
SCORES = 4_000_000


def batch_top_k(rows: DataFrame, queries: DataFrame, k: int, limit_bytes: int = 64_000_000) -> DataFrame:
    """The best ``k`` live rows for each query (``query_id``, ``query``).

    The queries are a stated set: they are dealt by hash into blocks of about ``limit_bytes``, which
    are fetched and sent to all tasks one after the other, each block over all rows. Returns
    ``query_id``, ``id``, ``score``, ``version``, ``rank``.
    """
    kind = queries.schema["query_id"].dataType
    empty = rows.sparkSession.createDataFrame([], f"query_id {kind.simpleString()}, id string, score double, version bigint")
    asked = queries.select("query_id", "query")
    blocks = 1 + 8 * (asked.agg(F.sum(F.size("query"))).first()[0] or 0) // limit_bytes
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    candidates = empty
    for n in range(blocks if k > 0 else 0):
        part = [tuple(r) for r in asked.where(block == n).collect()]
        if part:
            candidates = candidates.union(_candidates(rows, part, k, kind))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= k)


def _best(scores: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that may be among the best of each query: their queries, numbers and scores.

    ``scores`` has a line for each query. ``best`` has each query's best scores so far and takes in the
    new ones. Of equal scores the first rows count, and those equal to the least of the best are given too.
    """
    k = best.shape[1]
    floor = best.min(axis=1)
    if scores.shape[1] > k and np.isneginf(floor).any():
        floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
    query, row = np.nonzero(scores >= floor[:, None])
    score = scores[query, row]
    order = np.lexsort((row, -score, query))
    query, row, score = query[order], row[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    first = place < k
    query, row, score = query[first], row[first], score[first]
    new = np.full(best.shape, -np.inf)
    new[query, place[first]] = score
    best[:] = np.partition(np.concatenate([best, new], axis=1), k, axis=1)[:, k:]
    good = score >= best.min(axis=1)[query]
    return query[good], row[good], score[good]


def _candidates(rows: DataFrame, queries: list[tuple], k: int, kind: DataType) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(([q for q, _ in queries], np.array([v for _, v in queries], np.float64)))
    target = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        names = pa.array(names, target)
        best = np.full((len(q), k), -np.inf)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(0).to_pylist()
            by_id = pa.array(sorted(range(n), key=lambda i: ids[i].encode()))
            batch = batch.take(by_id)  # so that the first of ties are those of the least ids
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64).T
            step = max(1, SCORES // n)
            for at in range(0, len(q), step):
                query, row, score = _best(q[at : at + step] @ x, best[at : at + step])
                hits = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query + at)), hits.column(0), pa.array(score), hits.column(2)], ["query_id", "id", "score", "version"])

    vectors = rows.where(F.col("embedding").isNotNull()).select("id", "embedding", F.col("lamport").alias("version"))
    return vectors.mapInArrow(run, f"query_id {kind.simpleString()}, id string, score double, version bigint")
