import shutil

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, decontaminate, quality, secrets
from tidemark.llm._common import remainder
from tests.llm.test_models_and_graphs import slow_components, slow_fingerprint
from tests.llm.test_text_operators import slow_contamination

SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, odd_docs, tmp_path_factory):
    """The sample with odd rows added."""
    path = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    more = {"tags": F.create_map(F.lit("a"), F.col("lang")), "Row": F.lit(1), "score": F.lit("s"), "row_key": F.lit(None).cast("int"), "spans": F.lit("x")}
    docs = docs.withColumns(more)
    odd = odd_docs.select(*(c for c in docs.columns if c not in more)).withColumns(more).withColumn("doc_id", F.col("doc_id") + 10_000)
    secret = docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") - 1000).withColumn("text", F.concat("text", F.lit(' password = "hunter22xx"')))
    nameless = docs.where("doc_id = 21").withColumn("doc_id", F.lit(None).cast("bigint"))
    docs.where("doc_id <> 21").union(nameless).union(odd).union(secret).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SAMPLE}/{name}.parquet", path)
    return str(path)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        after = [r.asDict() for r in docs.collect()]
        key = lambda rows: sorted(rows, key=repr)
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            model = quality.train(spark.createDataFrame(before, docs.schema), spark.read.parquet(f"{folder}/labels.parquet"), remainder("doc_id", 5) != 0)
            want = [r for r in before if model.score(*quality.features(r["text"] or "", (r["n_chars"],))) >= 0.3]
            assert len(want) < len(before)
        elif k == 1:
            prints = [slow_fingerprint(r["text"]) for r in before]
            root = slow_components(range(len(before)), [(i, j) for i in range(len(before)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
            groups = {}
            for i, r in enumerate(before):
                groups.setdefault(root[i], []).append((r["doc_id"] is None, r["doc_id"] or 0, repr(r)))
            least = {g: min(rows) for g, rows in groups.items()}
            want = [next(r for r in before if repr(r) == least[g][2]) for g in groups]
            assert sum(r["doc_id"] is None for r in want) == 2
            assert len(want) < len(before)
        elif k == 2:
            bad = {r[0] for r in slow_contamination([(r["doc_id"], r["text"]) for r in before], [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]) if r[-1]}
            want = [r for r in before if r["doc_id"] not in bad]
            assert bad
        elif k == 3:
            encoding = secrets.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
            want = []
            for r in before:
                text = secrets.redact(r["text"] or "", secrets.find_spans(r["text"] or "", encoding))
                want.append(r | {"text": text, "n_chars": len(text)})
            assert any("<secret>" in r["text"] for r in want)
        else:
            own = bpe.encoder(public_tokenizers.path("byte_bpe_50k.json"))
            decoded = [(r["doc_id"], own.decode(np.array(r["ids"], "u4"))) for r in after]
            assert key(decoded) == key([(r["doc_id"], r["text"]) for r in before])
            want = after
        assert key(after) == key(want)


def test_run(spark):
    assert decontaminate.WINDOW == 10
    out = corpus_pipeline.run(spark, SAMPLE)
    assert 0 < out.count() < 200 and "n_tokens" in out.columns


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
