"""Language identification by hierarchical discrimination.

First a family is chosen, then a language within it; both by one-versus-one linear support vector
machines over hashed character n-grams. Related languages are thus told apart by machines that
look at nothing but their differences.

Executors turn texts into vectors and predict. The machines are fitted on the driver, on a sample
of bounded size (``per_language`` rows of each language are expected).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import text_or_empty

BUCKETS = 2048
#: Expected size of the training sample of each language.
PER_LANGUAGE = 1200
#: Fixed: families of languages. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indo_aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Multipliers of a hash of up to three bytes.
MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
CHUNK = 1 << 18


def vector(text: str) -> np.ndarray:
    """Hashed counts of byte n-grams (1 to 3) of a whole text, damped and of length 1."""
    data = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(LETTERS).split()) + b" ", np.uint8)
    counts = np.zeros(BUCKETS)
    for k in range(0, len(data), CHUNK):
        part = data[k : k + CHUNK + 2].astype(np.uint32)
        own = min(CHUNK, len(part))
        code = np.zeros(len(part), np.uint32)
        for n, mix in enumerate(MIX):
            if n >= len(part):
                break
            code = code[: len(part) - n] ^ ((part[n:] + np.uint32(n + 1)) * mix)
            code = (code << np.uint32(5)) | (code >> np.uint32(27))
            counts += np.bincount((code[:own] * MIX[0]) >> np.uint32(21), minlength=BUCKETS)
    values = np.sqrt(counts)
    return (values / np.linalg.norm(values)).astype(np.float32)


def fit_machine(x: np.ndarray, sign: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """A linear support vector machine: squared hinge loss, classes of equal weight, Adam."""
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(np.float32)
    w, m, s = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        slack = np.maximum(0, 1 - sign * (x @ w))
        slope = -2 * (weight * sign * slack) @ x + decay * w
        m += 0.1 * (slope - m)
        s += 0.001 * (slope * slope - s)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass
class Duel:
    """One-versus-one machines among ``names``."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Duel:
        names = sorted(set(y.tolist()))
        pairs = list(combinations(range(len(names)), 2))
        weights = []
        for a, b in pairs:
            rows = (y == names[a]) | (y == names[b])
            weights.append(fit_machine(x[rows], np.where(y[rows] == names[a], 1, -1).astype(np.float32)))
        return cls(names, pairs, np.array(weights, np.float32).reshape(len(pairs), x.shape[1]))

    def choose(self, x: np.ndarray) -> tuple[str, float]:
        """The name that wins most duels, ties by summed chances; its mean chance against the others."""
        if len(self.names) == 1:
            return self.names[0], 1.0
        chance = 1 / (1 + np.exp(-3 * (self.weights @ x)))
        won, summed = np.zeros(len(self.names)), np.zeros(len(self.names))
        for (a, b), p in zip(self.pairs, chance):
            won[a if p >= 0.5 else b] += 1
            summed[a] += p
            summed[b] += 1 - p
        best = max(range(len(self.names)), key=lambda k: (won[k], summed[k]))
        return self.names[best], float(summed[best] / (len(self.names) - 1))


@dataclass
class LanguageModel:
    families: Duel
    within: dict[str, Duel]

    def predict(self, text: str) -> tuple[str, float]:
        if not any(map(str.isalpha, text)):
            return "und", 0.0
        x = vector(text)
        family, p = self.families.choose(x)
        lang, q = self.within[family].choose(x)
        return lang, p * q


def fit(rows: list[tuple[np.ndarray, str]]) -> LanguageModel | None:
    """From (vector, language) rows; None without rows."""
    if not rows:
        return None
    x, y = np.stack([r[0] for r in rows]), np.array([r[1] for r in rows])
    family = np.array([FAMILY.get(lang, lang) for lang in y.tolist()])
    return LanguageModel(Duel.fit(x, family), {f: Duel.fit(x[family == f], y[family == f]) for f in set(family.tolist())})


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = pa.array([vector(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([vectors, batch.column("lang"), batch.column("place")], ["x", "lang", "place"])


def train(docs: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Fits the machines on rows with ``keep``, a condition on ``doc_id``.

    Of each language with n rows, the rows whose hash of the id is in the first ``per_language / n``
    of its range are taken, and of these no more than twice ``per_language``, by that hash (ids may be
    repeated), so the sample does not depend on the layout. Rows without a language
    or with a text that is null or has no letter are passed over.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = chosen.where(keep & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = chosen.where(keep & F.col("lang").isNotNull()).groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, per_language / r["count"]))])
    sample = usable.withColumn("place", place).where(F.col("place") <= share[F.col("lang")]).select("text", "lang", "place")
    vectors = sample.mapInArrow(_vectors, "x binary, lang string, place double")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "x"))
    found = vectors.withColumn("rank", rank).where(F.col("rank") <= 2 * per_language).collect()
    return fit([(np.frombuffer(r["x"], np.float32), r["lang"]) for r in found])


def identify_languages(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predicts the language of each whole text.

    Returns a row for each row of ``docs``: ``doc_id``, ``lang_pred`` and ``score`` (0 to 1). A text
    that is null or has no letter is ``und`` with score 0, as is any text without a model. Repeated
    rows and null ids stay, an empty table gives an empty one, other columns are not read.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    id_type = chosen.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = sent.value
        for batch in batches:
            found = [machines.predict(t.as_py()) if machines else ("und", 0.0) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return chosen.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")
