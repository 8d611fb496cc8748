"""Quantized vectors for inner products: rotation, scalar codebook, and a sign sketch of the rest.

A vector is normalised and rotated at random; each coordinate is then close to normal with variance
1/dim and takes the nearest of 2**(bits - 1) levels. What is left is projected at random, and the
projection's signs are kept. The estimate of an inner product adds both parts; it is unbiased.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 9
#: More than the rounding of the stored norms to single precision.
ROUNDED = 1e-6
COLUMNS = "q_mse binary, q_signs binary, q_rest float, q_norm float"


def levels(bits: int, rounds: int = 200) -> np.ndarray:
    """The best levels for a standard normal variable, by Lloyd's rounds on a fine grid."""
    grid = np.linspace(-6, 6, 24_001)
    weight = np.exp(-grid**2 / 2)
    found = np.linspace(-1.5, 1.5, 2**bits) if bits else np.zeros(1)
    for _ in range(rounds):
        cell = np.searchsorted((found[1:] + found[:-1]) / 2, grid)
        found = np.bincount(cell, weight * grid, len(found)) / np.bincount(cell, weight, len(found))
    return found


class Quantizer:
    def __init__(self, dim: int, bits: int = 2, seed: int = 0):
        if bits < 2 or bits > MOST_BITS:
            raise ValueError(f"bits must be from 2 to {MOST_BITS}")
        random = np.random.default_rng(seed)
        q, r = np.linalg.qr(random.normal(size=(dim, dim)))
        self.dim, self.rotation = dim, q * np.sign(np.diag(r))
        self.sketch = random.normal(size=(dim, dim))
        self.levels = levels(bits - 1) / np.sqrt(dim)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Level numbers and packed signs by row, norms of what is left, and norms."""
        norm = np.linalg.norm(x, axis=1)
        y = (x / np.where(norm > 0, norm, 1)[:, None]) @ self.rotation.T
        cell = np.searchsorted((self.levels[1:] + self.levels[:-1]) / 2, y).astype(np.uint8)
        rest = y - self.levels[cell]
        return cell, np.packbits(rest @ self.sketch.T > 0, axis=1), np.linalg.norm(rest, axis=1), norm

    def scores(self, queries: np.ndarray, cell: np.ndarray, signs: np.ndarray, rest: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Estimated inner products, (queries, rows)."""
        q = queries @ self.rotation.T
        sides = np.unpackbits(signs, axis=1, count=self.dim).astype(np.float64) * 2 - 1
        return (q @ self.levels[cell].T + np.sqrt(np.pi / 2) / self.dim * (q @ self.sketch.T) @ sides.T * rest) * norm

    def most(self, query: np.ndarray, cell: np.ndarray, rest: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """What no inner product with the query is above: the levels' part, and what is left as if it lay along the query."""
        q = self.rotation @ query
        return (self.levels[cell] @ q + np.linalg.norm(query) * (rest * (1 + ROUNDED) + ROUNDED)) * norm + np.abs(norm) * np.linalg.norm(query) * ROUNDED


@functools.lru_cache(4)
def quantizer(dim: int, bits: int, seed: int) -> Quantizer:
    """One for each worker."""
    return Quantizer(dim, bits, seed)


def quantized(rows: DataFrame, dim: int, bits: int = 2, seed: int = 0) -> DataFrame:
    """``id``, ``text``, ``metadata``, ``version`` and the quantized columns of the rows with a vector."""
    vectors = rows.where(F.col("embedding").isNotNull()).select("id", "text", "metadata", F.col("lamport").alias("version"), "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = quantizer(dim, bits, seed)
        for batch in batches:
            x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim).astype(np.float64)
            cell, signs, rest, norm = model.encode(x)
            made = [pa.array([r.tobytes() for r in cell], pa.binary()), pa.array([r.tobytes() for r in signs], pa.binary()), pa.array(rest, pa.float32()), pa.array(norm, pa.float32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made], ["id", "text", "metadata", "version", "q_mse", "q_signs", "q_rest", "q_norm"])

    return vectors.mapInArrow(run, f"id string, text string, metadata map<string,string>, version bigint, {COLUMNS}")


def quantized_top_k(table: DataFrame, query: list[float], k: int, bits: int = 2, seed: int = 0) -> DataFrame:
    """``id``, ``score`` and ``version`` of the best ``k`` by estimated scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, q = quantizer(len(query), bits, seed), np.array([query], np.float64)
        for batch in batches:
            bytes_of = lambda k: np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            score = model.scores(q, bytes_of("q_mse"), bytes_of("q_signs"), batch.column("q_rest").to_numpy(), batch.column("q_norm").to_numpy())[0] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score, pa.float64()), batch.column("version")], ["id", "score", "version"])

    numbers = table.select("id", "version", "q_mse", "q_signs", "q_rest", "q_norm")
    return numbers.mapInArrow(run, "id string, score double, version bigint").orderBy(F.desc("score"), "id").limit(max(0, k))


def may_reach(table: DataFrame, query: list[float], score: float, bits: int = 2, seed: int = 0) -> DataFrame:
    """``id`` of each row whose exact inner product may be ``score`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, q = quantizer(len(query), bits, seed), np.array(query, np.float64)
        for batch in batches:
            if batch.num_rows:
                cell = np.frombuffer(b"".join(batch.column("q_mse").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                most = model.most(q, cell, batch.column("q_rest").to_numpy().astype(np.float64), batch.column("q_norm").to_numpy().astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(most >= score))], ["id"])

    return table.select("id", "q_mse", "q_rest", "q_norm").mapInArrow(run, "id string")
