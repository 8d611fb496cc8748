import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import log, merge, search
from tidemark.operators.filters import all_of, meta_eq
from tidemark.schema import COLUMNS, LOG_SCHEMA, checked, normalised


def entry(id, lamport, actor="a", tombstone=False, text="", embedding=None, metadata=None, seq=None):
    return ("c", id, embedding, text, metadata, lamport, actor, None, tombstone, lamport if seq is None else seq)


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(
        [
            entry("x", 1, text="alpha", embedding=[1.0, 0.0], metadata={"source": "code"}), entry("x", 2, text="beta", embedding=[0.0, 1.0], metadata={"source": "notes"}),
            entry("x", 4, tombstone=True), entry("y", 3, text="first", embedding=[1.0, 1.0]), entry("y", 3, "b", text="second", embedding=[2.0, 0.0]), entry("y", 3, "b", text="late", seq=99),
            entry("z", 5, tombstone=True), entry("z", 6, text="back", embedding=[0.5, 0.5], metadata={}),
        ],
        LOG_SCHEMA,
    )


def test_latest_live_and_history(rows):
    assert {r.id: (r.lamport, r.actor_id, r.text) for r in log.latest(rows).collect()} == {"x": (4, "a", ""), "y": (3, "b", "second"), "z": (6, "a", "back")}
    assert {r.id for r in log.live(rows).collect()} == {"y", "z"}
    assert {r.id: r.text for r in log.live(rows, 2).collect()} == {"x": "beta"}
    assert [r.text for r in log.history(rows, "y").collect()] == ["first", "second"]
    assert log.history(rows, "nobody").count() == 0
    assert [r.id for r in log.revived(rows).collect()] == ["z"]
    assert {r.lamport: r.text for r in log.carried_forward(rows).where("tombstone").collect()} == {4: "beta", 5: None}


@pytest.mark.parametrize("block", [1, 3, 1_000_000])
def test_blocks_of_clocks(spark, block):
    rng = random.Random(block)
    made = [entry(rng.choice("xyz"), k, actor, rng.random() < 0.4, rng.choice([None, f"t{k}"]), metadata={"k": str(k)} if rng.random() < 0.5 else None) for k in rng.sample(range(60), 40) for actor in rng.sample("ab", rng.randint(1, 2))]
    frame = spark.createDataFrame(made, LOG_SCHEMA)
    text, back = {}, set()
    for id in "xyz":
        last, before = None, False
        for r in sorted((r for r in made if r[1] == id), key=lambda r: (r[5], r[6])):
            text[id, r[5], r[6]] = last if r[8] else r[3]
            last = last if r[8] or r[3] is None else r[3]
            if before and not r[8]:
                back.add((id, r[5], r[6]))
            before = r[8]
    assert {(r.id, r.lamport, r.actor_id): r.text for r in log.carried_forward(frame, block=block).collect()} == text
    assert {(r.id, r.lamport, r.actor_id) for r in log.revived(frame, block=block).collect()} == back
    parts = log.grouped_history(frame, "text", block=block).orderBy("id", "part").collect()
    whole = [(r.id, v.lamport, v.actor_id) for r in parts for v in r.versions]
    assert whole == sorted(text) and all(v.lamport // block == r.part for r in parts for v in r.versions)


def test_numbers_do_not_change_with_ties(spark):
    frame = spark.createDataFrame([(k % 3, {"k": str(k)}) for k in range(500)], "v int, m map<string,string>")
    runs = [{r.m["k"]: (r.n, r.v) for r in log.numbered(f, "v", "n", ranges=9).collect()} for f in (frame.repartition(3), frame.repartition(7))]
    assert runs[0] == runs[1] and sorted(n for n, _ in runs[0].values()) == list(range(500))
    assert [v for _, v in sorted(runs[0].values())] == sorted(k % 3 for k in range(500))


def test_deletions_carry_text_on(spark, rows):
    ids = spark.createDataFrame([("c", "y", 0), ("c", "new", 1), ("c", "x", 2)], "collection string, id string, seq bigint")
    gone = log.deletions(rows, ids, 10, "b")
    assert {r.id: (r.lamport, r.text, r.tombstone) for r in gone.collect()} == {"y": (10, "second", True), "new": (11, "", True), "x": (12, "", True)}
    assert {r.id for r in log.live(rows.unionByName(gone)).collect()} == {"z"}


def test_merge_is_commutative_and_idempotent(spark):
    rng = random.Random(5)
    def some(n):
        return [entry(str(rng.randrange(6)), rng.randrange(8), rng.choice("ab"), rng.random() < 0.3, seq=rng.randrange(1000)) for _ in range(n)]

    a, b = (spark.createDataFrame([(*r[:-1], 10 * k + j * 100_000) for k, r in enumerate(some(40))], LOG_SCHEMA) for j in range(2))
    key = lambda df: sorted((r.id, r.lamport, r.actor_id, r.tombstone, r.ingest_seq) for r in df.collect())
    both = merge.crdt_merge(a, b)
    assert key(both) == key(merge.crdt_merge(b, a)) == key(merge.crdt_merge(both, a, b))
    assert key(log.latest(log.as_of(both, 10**6))) == key(log.latest(both))
    assert key(log.dedup(both)) == key(both) and merge.unseen(both, b).count() == 0
    snapshot = log.as_of(both, 4)
    assert key(snapshot.unionByName(merge.unseen(snapshot, both))) == key(both)


def test_clocks(spark, rows):
    assert log.latest_clock(rows).first().clock == 6
    seen = log.witnessed(rows.withColumn("lamport", F.col("lamport") * 7 % 5), block=2).orderBy("ingest_seq").collect()
    best = 0
    for r in seen:
        best = max(best, r.lamport)
        assert r.clock == best
    names = spark.createDataFrame([(f"id-{k}",) for k in random.Random(1).sample(range(10_000), 5000)], "id string").repartition(7)
    numbered = log.numbered(names, "id", "n", first=3, ranges=16).orderBy("id").collect()
    assert [r.n for r in numbered] == list(range(3, 5003))
    assert log.numbered(names.limit(0), "id", "n").count() == 0


def test_filters(spark):
    rows = spark.createDataFrame([(1, {"a": "x"}), (2, {"b": "x"}), (3, {}), (4, None)], "id int, metadata map<string,string>")
    ids = lambda c: [r.id for r in rows.where(c).orderBy("id").collect()]
    assert ids(meta_eq("a", "x")) == [1] and ids(meta_eq("a", "")) == [2] and ids(all_of()) == [1, 2, 3, 4]
    assert ids(all_of(meta_eq("a", "x"), meta_eq("b", ""))) == [1]


def test_normalised_and_checked(spark):
    good = normalised(spark.createDataFrame([("c", "x", [], None, {}, 1, "a", None, None, 1)], LOG_SCHEMA)).first()
    assert (good.embedding, good.metadata, good.text, good.tombstone) == (None, None, "", False)
    for bad in (entry("  ", 1), entry(None, 1), entry("x", 1, embedding=[1.0]), entry("x", 1, embedding=[float("nan"), 0.0]), entry("x", 1, embedding=[float("inf"), 0.0])):
        with pytest.raises(Exception, match="blank id|dimension|finite"):
            checked(spark.createDataFrame([bad], LOG_SCHEMA), 2).collect()
    assert checked(spark.createDataFrame([entry("x", 1, tombstone=True)], LOG_SCHEMA), 2).select(*COLUMNS).count() == 1


def test_search(spark, rows):
    hits = search.search(rows, [1.0, 0.0], 5).collect()
    assert [(r.id, r.score, r.version) for r in hits] == [("y", 2.0, 3), ("z", 0.5, 6)]
    assert [r.id for r in search.search(rows, [0.0, 1.0], 5, clock=2).collect()] == ["x"]
    assert search.search(rows, [1.0, 0.0], 5, meta_eq("source", "code")).count() == 0  # only an old version has it
    assert search.search(rows, [1.0, 0.0], 0).count() == search.search(rows, [1.0, 0.0], -1).count() == 0
    ties = spark.createDataFrame([entry(i, k + 1, embedding=[1.0, 0.0]) for k, i in enumerate(["b", "a", "é", "z", "c"])], LOG_SCHEMA)
    assert [r.id for r in search.search(ties, [1.0, 0.0], 3).collect()] == ["a", "b", "c"]


def test_batch_search_equals_single(spark):
    rng = random.Random(2)
    points = spark.createDataFrame([entry(str(k), k, embedding=[rng.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(4)]) for k in range(300)], LOG_SCHEMA).repartition(3)
    asked = [(q, [rng.uniform(-1, 1) for _ in range(4)]) for q in range(5)]
    queries = spark.createDataFrame(asked, "query_id int, query array<double>")
    for limit in (64_000_000, 40):
        got = {}
        for r in search.batch_top_k(points, queries, 7, limit).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, round(r.score, 9)))
        assert got == {q: [(r.id, round(r.score, 9)) for r in search.search(points, v, 7).collect()] for q, v in asked}
    assert search.batch_top_k(points, queries.limit(0), 3).count() == search.batch_top_k(points, queries, 0).count() == 0


def test_batch_search_in_small_products(spark, monkeypatch):
    monkeypatch.setattr(search, "SCORES", 7)
    points = spark.createDataFrame([entry(f"p{k:02d}", k, embedding=[float(k % 4), 1.0]) for k in range(40)], LOG_SCHEMA).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)
    try:
        queries = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(3)], "query_id int, query array<double>")
        got = [(r.query_id, r.id) for r in search.batch_top_k(points, queries, 12).orderBy("query_id", "rank").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = sorted(range(40), key=lambda k: (-(k % 4), k))[:12]
    assert got == [(q, f"p{k:02d}") for q in range(3) for k in order]


def test_shards(spark):
    hits = "id string, score double, version bigint, member int"
    both = spark.createDataFrame([("x", 1.0, 1, 0), ("y", 0.5, 9, 0), ("x", 1.0, 2, 1), ("y", 0.4, 10, 1), ("w", 1.0, 1, 1)], hits)
    assert [tuple(r) for r in merge.merge_shards(both, 3).collect()] == [("w", 1.0, 1), ("x", 1.0, 2), ("y", 0.5, 9)]
    assert merge.merge_shards(both, 0).count() == 0 and [r.id for r in merge.merge_shards(both, 1).collect()] == ["w"]
    number = 16440537606581960914  # FNV-1a of "docs\\0doc-peer-0"
    high, low = merge.fnv1a(merge.byte_codes(F.lit("docs\0doc-peer-0")))
    row = spark.range(1).select(high.alias("h"), low.alias("l"), merge.owner_of(F.lit("docs"), F.lit("doc-peer-0"), ["c", "a", "b", "a", ""]).alias("o")).first()
    assert (row.h << 32) + row.l == number and row.o == "abc"[number % 3]
