"""Text encoders, run in Arrow batches.

A provider is any object with ``name``, ``dim`` and ``encode(texts) -> array of (n, dim)``. The
built-in one hashes words and word pairs into buckets.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: parameters of the hashed embedding.
DIM = 384
OFFSET = 1469598103934665603
PRIME = 1099511628211
GAMMA = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
DRAWS = 4
MASK = (1 << 64) - 1
#: Longer features are hashed one by one.
LONG = 64
#: Words after which a batch is worked off.
FEATURES = 50_000
#: Texts that a worker encodes at once.
ROWS = 500


class Provider(Protocol):
    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class _Normal(dict):
    """For ``str.translate``: the lower case of letters and decimal digits, spaces for anything else."""

    def __missing__(self, code: int) -> str:
        c = "i" if chr(code) == "İ" else chr(code).lower() if len(chr(code).lower()) == 1 else chr(code)
        self[code] = c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " "
        return self[code]


NORMAL = _Normal()


def normalise_text(text: str) -> str:
    """Lower case letter by letter; all but letters, decimal digits and spaces to spaces; spaces joined."""
    return " ".join(text.translate(NORMAL).split())


def features_of(normal: str) -> list[str]:
    """Each word as ``w:word``, followed by ``p:word_next`` if there is a next one."""
    words = normal.split()
    out = []
    for k, word in enumerate(words):
        out.append("w:" + word)
        if k + 1 < len(words):
            out.append(f"p:{word}_{words[k + 1]}")
    return out


def fnv_state(feature: str) -> int:
    state = OFFSET
    for c in feature:
        state = (state ^ ord(c)) * PRIME & MASK
    return state


def buckets(feature: str, dim: int = DIM) -> list[int]:
    """The bucket of each draw; the n-th weighs 1/n."""
    state, out = fnv_state(feature), []
    for k in range(DRAWS):
        x = state + k * GAMMA + GAMMA & MASK
        for shift, factor in zip((30, 27), MIX):
            x = (x ^ x >> shift) * factor & MASK
        state = x ^ x >> 31
        out.append(state % dim)
    return out


def fold(state: np.ndarray, points: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """States after ``size`` more code points of ``points`` from ``first`` on."""
    state, left = state.copy(), np.argsort(-size, kind="stable")
    sizes = -size[left]
    for place in range(int(size.max(initial=0))):
        left = left[: np.searchsorted(sizes, -place)]
        state[left] = (state[left] ^ points[first[left] + place]) * np.uint64(PRIME)
    return state


def drawn(state: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The buckets that follow from each state, (states, draws)."""
    out = np.empty((len(state), DRAWS), np.int64)
    for draw in range(DRAWS):
        x = state + np.uint64((draw + 1) * GAMMA & MASK)
        for shift, factor in zip((30, 27), MIX):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        state = x ^ (x >> np.uint64(31))
        out[:, draw] = (state % np.uint64(dim)).astype(np.int64)
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts, and where each text's begin and how many they are."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.cumsum(size) - size, size


def bucket_rows(features: list[str], dim: int = DIM) -> np.ndarray:
    """``buckets`` of many features at once, (features, draws)."""
    out = np.empty((len(features), DRAWS), np.int64)
    long = [k for k, f in enumerate(features) if len(f) > LONG]
    short = [k for k, f in enumerate(features) if len(f) <= LONG] if long else None
    for k in long:
        out[k] = buckets(features[k], dim)
    chosen = features if short is None else [features[k] for k in short]
    found = drawn(fold(np.full(len(chosen), OFFSET, np.uint64), *code_points(chosen)), dim)
    out[slice(None) if short is None else short] = found
    return out


class _Numbers(dict):
    """Numbers from 0 on, in the order in which keys come up."""

    def __missing__(self, key: str) -> int:
        self[key] = len(self)
        return self[key]


class HashedEmbedding:
    """The built-in provider."""

    name = "builtin-deterministic-v1"

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        """Each different word of some texts is hashed once; a pair goes on from the state of its first word."""
        out = np.zeros((len(texts), self.dim), np.float32)
        number = _Numbers()
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0
        for place, text in enumerate(texts):
            words = normalise_text(text or "").split()
            if words:
                waiting.append((place, np.array(list(map(number.__getitem__, words)))))
                held += len(words)
            if held > FEATURES:
                self._add(out, list(number), waiting)
                number, waiting, held = _Numbers(), [], 0
        self._add(out, list(number), waiting)
        return out

    def _add(self, out: np.ndarray, words: list[str], waiting: list[tuple[int, np.ndarray]]) -> None:
        if not waiting:
            return
        starts = [np.full(len(words), fnv_state(mark), np.uint64) for mark in ("w:", "p:")]
        points = code_points(words)
        alone, paired = (fold(state, *points) for state in starts)
        paired = (paired ^ np.uint64(ord("_"))) * np.uint64(PRIME)
        word = np.concatenate([w for _, w in waiting])
        row = np.repeat(np.arange(len(waiting)), [len(w) for _, w in waiting])
        follows = np.flatnonzero(row[1:] == row[:-1])
        after = word[follows + 1]
        pair = fold(paired[word[follows]], points[0], points[1][after], points[2][after])
        weights = np.array([1 / n for n in range(1, DRAWS + 1)], np.float32)
        at = np.concatenate([drawn(alone, self.dim)[word], drawn(pair, self.dim)]) + self.dim * np.concatenate([row, row[follows]])[:, None]
        sums = np.bincount(at.ravel(), np.tile(weights, len(at)), self.dim * len(waiting)).astype(np.float32).reshape(-1, self.dim)
        scale = (1 / np.sqrt((sums * sums).astype(np.float64).sum(axis=1))).astype(np.float32)
        out[[place for place, _ in waiting]] = sums * scale[:, None]


def encoded(text: Column, make: Callable[[], Provider] = HashedEmbedding) -> Column:
    """The embedding of a text column. ``make`` is called once in each worker."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        provider = make()
        for texts in batches:
            for k in range(0, len(texts), ROWS):
                part = texts.slice(k, ROWS).to_pylist()
                made = np.asarray(provider.encode(part), np.float32).reshape(len(part), -1)
                ends = np.arange(0, made.size + 1, made.shape[1], dtype=np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(made.ravel()))

    return run(F.coalesce(text, F.lit("")))


def feature_buckets(feature: Column, dim: int = DIM) -> Column:
    """The buckets of a feature, one for each draw."""

    @F.arrow_udf("array<bigint>")
    def run(features: pa.Array) -> pa.Array:
        found = bucket_rows(features.to_pylist(), dim)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, DRAWS, dtype=np.int32)), pa.array(found.ravel()))

    return run(feature)


def normal_text(text: Column) -> Column:
    """``normalise_text`` by built-in functions; they differ only where lower case changes a letter's number."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " "))


def text_features(normal: Column) -> Column:
    """``features_of`` by built-in functions, for non-empty normalised texts."""
    words = F.filter(F.split(normal, " "), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.array(F.concat(F.lit("w:"), a), F.concat(F.lit("p:"), a, F.lit("_"), b)))
    return F.array_compact(F.flatten(pairs))


def feature_rows(texts: DataFrame, normal: Column, *keys: str) -> DataFrame:
    """A row with ``keys`` and ``feature`` for each of ``text_features``, by generators in place of functions of arrays."""
    words = texts.select(*keys, F.split(F.nullif(normal, F.lit("")), " ").alias("w"))
    zipped = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))
    both = words.select(*keys, F.explode(zipped).alias("p")).select(*keys, "p.a", "p.b")
    features = F.array(F.concat(F.lit("w:"), "a"), F.concat(F.lit("p:"), "a", F.lit("_"), "b"))
    return both.select(*keys, F.explode(features).alias("feature")).where("feature IS NOT NULL")
