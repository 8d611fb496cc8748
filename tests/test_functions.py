import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import embed, quantize, tokenize
from tidemark.plans.catalogue import recall
from tidemark.schema import LOG_SCHEMA


def test_known_hashes():
    known = {
        "w:hello": (8356314873828659770, [282, 144, 374, 135]), "w:world": (12833599098432886670, [63, 348, 317, 320]),
        "p:hello_world": (8564242450447913308, [341, 229, 180, 162]), "w:passkeys": (16629633661924222699, [37, 267, 327, 78]),
    }
    assert {f: (embed.fnv_state(f), embed.buckets(f)) for f in known} == known
    odd = [*known, "w:" + "x" * 200, "w:日本", "w:é"]
    assert embed.bucket_rows(odd).tolist() == [embed.buckets(f) for f in odd]


def test_embedding(spark):
    one = embed.HashedEmbedding().encode(["Hello, WORLD!", "  ", "!!", "hello world", "İstanbul"])
    assert np.allclose(np.linalg.norm(one, axis=1), [1, 0, 0, 1, 1]) and (one >= 0).all() and (one[0] == one[3]).all()
    want = np.zeros(384)
    for f in ("w:hello", "p:hello_world", "w:world"):
        for k, b in enumerate(embed.buckets(f)):
            want[b] += 1 / (k + 1)
    assert np.allclose(one[0], want / np.linalg.norm(want), atol=1e-6)
    rows = spark.createDataFrame([("Hello, WORLD!",), (None,)], "text string").select(embed.encoded(F.col("text")).alias("e")).collect()
    assert np.allclose(rows[0].e, one[0]) and not any(rows[1].e)


def test_text_functions_agree(spark):
    texts = ["Hello, WORLD!", "é ß 12 x_y", "", "…", "a  b\tc", "naïvé 9٤"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", embed.normal_text(F.col("t")).alias("n")).select("t", "n", embed.text_features(F.col("n")).alias("f")).collect()
    for r in rows:
        assert r.n == embed.normalise_text(r.t) and sorted(r.f) == sorted(embed.features_of(r.n))
    assert embed.normalise_text("ΑΣ İ") == "ασ i"


def test_embedding_in_slices(monkeypatch):
    texts = [f"word{k} and word{k % 3} again" for k in range(50)]
    want = embed.HashedEmbedding().encode(texts)
    monkeypatch.setattr(embed, "FEATURES", 7)
    assert (embed.HashedEmbedding().encode(texts) == want).all()


def test_quantizer(spark):
    assert recall() >= 0.78
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(400, 48)), rng.normal(size=(200, 48))
    model = quantize.quantizer(48, 3, 5)
    error = model.scores(q, *model.encode(x)) - q @ x.T
    assert abs(error.mean()) < 0.05 and error.std() < 0.45 * (q @ x.T).std()  # sqrt(pi/2) times the rest of two bits is 0.43
    rows = spark.createDataFrame([("c", str(k), v.tolist(), "", None, k, "a", None, False, k) for k, v in enumerate(x[:50])], LOG_SCHEMA)
    table = quantize.quantized(rows, 48, 3, 5)
    got = quantize.quantized_top_k(table, q[0].tolist(), 5, 3, 5).collect()
    best = np.argsort(-model.scores(q[:1], *model.encode(x[:50].astype(np.float32).astype(float)))[0])[:5]
    assert [r.id for r in got] == [str(k) for k in best]
    with pytest.raises(ValueError):
        quantize.Quantizer(8, 1)
    levels = quantize.levels(1)
    assert np.allclose(levels, [-math.sqrt(2 / math.pi), math.sqrt(2 / math.pi)], atol=1e-3)


@pytest.fixture
def small(tmp_path):
    """A vocabulary of the letters of "tidal basin" with a few merges, by way of files."""
    pieces = [*"tidalbsn ", "ti", "da", "dal", "bas", "as", "in"]
    merges = "# rank order\nt i\nd a\nda l\n\na s\nb as\ni n\n"
    special = {name: 500 + k for k, name in enumerate(tokenize.SPECIAL)}

    def make(spark, with_special):
        vocab = {p: 3 * k for k, p in enumerate(pieces)} | (special if with_special else {})
        (tmp_path / "vocab.json").write_text(json.dumps(vocab))
        (tmp_path / "merges.txt").write_text(merges)
        return tokenize.read_tokenizer(spark, str(tmp_path / "vocab.json"), str(tmp_path / "merges.txt"))

    return make


def test_tokenizer(spark, small):
    full, bare = small(spark, True), small(spark, False)
    number = lambda *pieces: [full.vocab[p] for p in pieces]
    assert bare.encode("tidal basin") == number("ti", "dal", " ", "bas", "in") and full.decode(full.encode("tidal basin")) == "tidal basin"
    assert full.encode("an") == [500, *number("a", "n"), 501] and full.encode("") == [500, 501] and bare.encode("") == []
    assert full.encode("tz") == [500, *number("t"), 503, 501] and bare.encode("tz") == number("t") and len(full) == len(bare) + 4
    assert full.decode([9999, -1, *number("dal")]) == "dal"
    marked = tokenize.Tokenizer({"a": 0, "Ġ": 1, "Ġa": 2, ".": 3}, [("Ġ", "a")])
    assert marked.encode("a a.  .a") == [0, 2, 3, 1, 3, 0] and marked.decode([0, 2, 3]) == "a a."
    text = "It's  a\t(test) - né!"
    row = spark.createDataFrame([(text,)], "t string").select(tokenize.simple_words(F.col("t")).alias("w"), tokenize.encoded_ids(F.col("t"), full).alias("i")).select("w", "i", tokenize.decoded_text(F.col("i"), full).alias("d")).first()
    assert row.w == tokenize.words_simple(text) and "".join(row.w) == text and row.i == full.encode(text) and row.d == full.decode(full.encode(text))
