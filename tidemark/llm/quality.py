"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a vector x: hashed word frequencies, shares of characters and lines, and numeric
metadata. The machine scores it as w0 + w.x + sum over pairs of <v_i, v_j> x_i x_j. The pair term
is half of |sum v_i x_i|^2 - sum |v_i|^2 x_i^2, which takes time linear in the entries of x.

Executors turn texts into vectors and score them. The model is fitted on the driver, on a sample of
labelled rows of bounded size (``max_rows``), chosen by a hash of the id.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import slices, text_or_empty

WORDS = 2048
FACTORS = 8
#: Bound of the training sample.
MAX_ROWS = 6000
THRESHOLD = 0.3
#: ASCII letters to lower case, other ASCII to spaces.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(text: str, meta: tuple[float | None, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their weights (of length 1 together), and the statistics of a whole text."""
    data = text.encode()
    counts = Counter(data.translate(LETTERS).split())
    total = sum(counts.values())
    buckets = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) % WORDS
    weights = np.bincount(buckets, np.fromiter(counts.values(), np.float64, len(counts)), WORDS) if total else np.zeros(WORDS)
    at = np.flatnonzero(weights)
    values = np.sqrt(weights[at] / total) if total else weights[at]
    chars = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / max(1, len(data))
    lines = data.split(b"\n")
    stats = [
        np.log1p(len(data)), total / max(1, len(data)), len(counts) / max(1, total), max(counts.values(), default=0) / max(1, total),
        1 - len(set(lines)) / len(lines), np.log1p(len(data) / len(lines)),
        chars[65:91].sum(), chars[97:123].sum(), chars[48:58].sum(), chars[128:].sum(), chars[32], chars[10],
        *np.sqrt(chars[list(MARKS)]),
        *(np.log1p(max(0.0, len(text) if m is None else m)) for m in meta),
    ]
    return at.astype(np.int32), values.astype(np.float32), np.array(stats, np.float32)


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, at: np.ndarray, values: np.ndarray, stats: np.ndarray) -> float:
        """The probability of label 1, in time linear in the entries."""
        n = len(self.linear) - len(stats)
        at = np.concatenate([at, np.arange(n, len(self.linear))])
        x = np.concatenate([values, standard(stats, self.mean, self.scale)])
        v = self.factors[at] * x[:, None]
        z = self.bias + self.linear[at] @ x + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def standard(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (np.clip((stats - mean) / scale, -4, 4) / 4).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], epochs: int = 60, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine | None:
    """Adam on the logistic loss. Rows are (buckets, weights, statistics, label); None without rows."""
    if not rows:
        return None
    stats = np.stack([r[2] for r in rows])
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-3
    size = WORDS + stats.shape[1]
    x = np.zeros((len(rows), size), np.float32)
    for k, (at, values, _, _) in enumerate(rows):
        x[k, at] = values
    x[:, WORDS:] = standard(stats, mean, scale)
    y = np.array([r[3] for r in rows], np.float32)
    random = np.random.default_rng(seed)
    share = np.clip(y.mean(), 0.01, 0.99)
    state = [np.array([np.log(share / (1 - share))]), np.zeros(size), random.normal(0, 0.05, (size, FACTORS))]
    first, second = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state]
    t = 0
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for k in range(0, len(rows), batch):
            xb, yb = x[order[k : k + batch]], y[order[k : k + batch]]
            v = state[2]
            inner = xb @ v
            z = state[0] + xb @ state[1] + 0.5 * ((inner**2).sum(axis=1) - (xb**2) @ (v**2).sum(axis=1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - yb) / len(yb)
            slopes = [np.array([g.sum()]), xb.T @ g + decay * state[1], xb.T @ (g[:, None] * inner) - v * ((xb**2).T @ g)[:, None] + decay * v]
            t += 1
            for p, m, s, d in zip(state, first, second, slopes):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return FactorisationMachine(float(state[0][0]), state[1].astype(np.float32), state[2].astype(np.float32), mean, scale)


def _chosen(docs: DataFrame, id_col: str, text_col: str, meta_cols: tuple[str, ...]) -> DataFrame:
    column = lambda c: F.col(c) if c in docs.columns else F.lit(None)
    meta = F.array(*[column(c).cast("double") for c in meta_cols]) if meta_cols else F.array().cast("array<double>")
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), meta.alias("meta"))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t.as_py(), tuple(m.as_py())) for t, m in zip(batch.column("text"), batch.column("meta"))]
        columns = [pa.array([f[k].tobytes() for f in found], pa.binary()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, batch.column("label")], ["at", "weights", "stats", "label"])


def train(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: tuple[str, ...] = ("n_chars",), max_rows: int = MAX_ROWS) -> FactorisationMachine | None:
    """Fits the machine on at most ``max_rows`` labelled rows with ``keep``, a condition on ``doc_id``.

    The rows are those of the least hash of the id, and of rows with one id the one of the least hash
    of its text, so the sample does not depend on the layout. A column of ``meta_cols`` that is
    missing counts as null. Labels other than 0 and 1 and null ids are passed over; None if no labelled document is left.
    """
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(keep & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    sample = marked.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = _chosen(docs, id_col, text_col, meta_cols).join(F.broadcast(sample), "doc_id")  # the sample is bounded
    single = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "meta", "label"), F.xxhash64("text")).alias("row")).select("row.*")
    found = single.mapInArrow(_vectors, "at binary, weights binary, stats binary, label int").collect()  # at most max_rows
    return fit([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["weights"], np.float32), np.frombuffer(r["stats"], np.float32), r["label"]) for r in found])


def score_quality(docs: DataFrame, model: FactorisationMachine | None, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("n_chars",), threshold: float = THRESHOLD) -> DataFrame:
    """Scores whole texts.

    Returns a row for each row of ``docs``: ``doc_id``, ``score`` (0 to 1, higher: label 1 likelier)
    and ``predicted`` (1 from ``threshold`` on). A null text counts as empty, and an empty text is
    scored by its statistics; null metadata counts as the text's length; without a model each score
    is 0.5. Repeated rows and null ids stay, an empty table gives an empty one, other columns are
    not read.
    """
    chosen = _chosen(docs, id_col, text_col, meta_cols)
    id_type = chosen.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        for batch in batches:
            scores = [machine.score(*features(t.as_py(), tuple(m.as_py()))) if machine else 0.5 for t, m in zip(batch.column("text"), batch.column("meta"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = chosen.mapInArrow(run, f"doc_id {id_type}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: FactorisationMachine | None, text_col: str = "text", meta_cols: tuple[str, ...] = ("n_chars",), threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more; see ``score_quality``.

    Each row is judged by itself, so null and repeated ids do no harm; an empty table gives an empty one;
    a column of ``meta_cols`` that is missing counts as null.
    """
    text_at, meta_at = docs.columns.index(text_col), [docs.columns.index(c) if c in docs.columns else None for c in meta_cols]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        for batch in slices(batches):
            columns = [[None] * batch.num_rows if k is None else batch.column(k).to_pylist() for k in meta_at]
            meta = [tuple(None if m is None else float(m) for m in row) for row in zip(*columns)] if columns else [()] * batch.num_rows
            scores = [machine.score(*features(t.as_py() or "", row)) if machine else 0.5 for t, row in zip(batch.column(text_at), meta)]
            yield batch.filter(pa.array([s >= threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
