"""That work and memory stay in proportion to the input, read off plans and small runs."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import embed, tokenize
from tidemark.plans import catalogue


@pytest.fixture
def repeated(spark, tmp_path):
    """Documents of which some share an id, with null texts."""
    rows = [(1, "tide and tide, and tide"), (2, None), (1, "tide and basin"), (3, ""), (None, "a  b a"), (4, "!!")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), rows


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, column", [("text_features", "feature"), ("pretokenize_simple", "word")])
def test_words_are_counted_without_a_shuffle_of_words(spark, repeated, name, column):
    folder, rows = repeated
    counted = catalogue.QUERIES[name](spark, folder)
    assert "hashpartitioning(doc_id" in plan_of(counted) and f", {column}#" not in "".join(line for line in plan_of(counted).splitlines() if "Exchange" in line)
    parts = (lambda t: embed.features_of(embed.normalise_text(t))) if name == "text_features" else tokenize.words_simple
    want = Counter((doc, part) for doc, text in rows for part in parts(text or ""))
    assert {(r[0], r[1]): r["n"] for r in counted.collect()} == want


def test_features_need_no_functions_of_arrays(spark, repeated):
    folder, rows = repeated
    found = catalogue.QUERIES["feature_buckets"](spark, folder)
    assert "lambda" not in plan_of(found)
    want = {f: tuple(embed.buckets(f)) for _, t in rows for f in embed.features_of(embed.normalise_text(t or ""))}
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == want


def test_pairs_are_hashed_from_their_words(monkeypatch):
    """Only the different words are laid out letter by letter, not the pairs."""
    seen = []
    points = embed.code_points
    monkeypatch.setattr(embed, "code_points", lambda texts: seen.extend(texts) or points(texts))
    texts = ["one two one two three", "", "\u65e5\u672c " + "x" * 200 + " one", None, "one"]
    made = embed.HashedEmbedding().encode(texts)
    assert sorted(seen) == sorted({w for t in texts for w in (t or "").split()})
    for text, row in zip(texts, made):
        want = np.zeros(embed.DIM)
        for f in embed.features_of(text or ""):
            for k, b in enumerate(embed.buckets(f)):
                want[b] += 1 / (k + 1)
        assert np.allclose(row, want / (np.linalg.norm(want) or 1), atol=1e-6)


def test_ids_are_handed_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(tokenize, "CHARACTERS", 10)
    tokenizer = tokenize.Tokenizer({"a": 0, "b": 1, "ab": 2}, [("a", "b")])
    texts = ["abab", "b" * 50, None, "", "ab" * 3, "x", "aab"]
    pieces = list(tokenize.ids_in_pieces(iter([pa.array(texts, pa.string()), pa.array([], pa.string())]), tokenizer))
    assert [len(p) for p in pieces] == [2, 5] and [i for p in pieces for i in p.to_pylist()] == [tokenizer.encode(t or "") for t in texts]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tokenize.encoded_ids(F.col("t"), tokenizer).alias("i")).collect()
    assert [r.i for r in rows] == [tokenizer.encode(t or "") for t in texts]
