"""Named queries over the test tables, each with its equivalent in DuckDB SQL where SQL can express it.

``events`` stands for a mutation log (errors are tombstones), ``embeddings`` and ``documents`` for
vector and text collections.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import embed, quantize, tokenize
from tidemark.operators import log, merge, search
from tidemark.operators.filters import all_of, meta_eq
from tidemark.sources.database import Database
from tidemark.streaming import replicate

QUERIES, ORACLES = {}, {}
NO_VECTOR = "CAST(NULL AS array<float>)"


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one of the session; in a temporary one only where all runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='spark-')}/{name}-{uuid.uuid4().hex}"


#: Text in a partition of documents; its different words and pairs are counted in memory.
PART_BYTES = 4_000_000


def by_document(docs: DataFrame) -> DataFrame:
    """The texts dealt by document, so that what is counted by document and word needs no shuffle of the words."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.select("doc_id", "text").repartition(max(docs.sparkSession.sparkContext.defaultParallelism, size // PART_BYTES), "doc_id")


def event_log(spark: SparkSession, sf_dir: str, vectors: bool = False, actor: str = "a") -> DataFrame:
    """events as a log; with ``vectors`` each version has the embedding of its number modulo their count."""
    rows = read(spark, sf_dir, "events").select(
        F.lit("events").alias("collection"), F.col("user_id").cast("string").alias("id"), F.col("props").alias("text"), F.create_map(F.lit("event_type"), "event_type").alias("metadata"),
        (F.col("event_id") + 1).alias("lamport"), F.lit(actor).alias("actor_id"), F.col("ts").alias("wall_clock"), (F.col("event_type") == "error").alias("tombstone"), F.col("event_id").alias("ingest_seq"),
    )
    if not vectors:
        return rows.withColumn("embedding", F.expr(NO_VECTOR))
    points = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    numbered = rows.withColumn("vec_id", F.when(~F.col("tombstone"), F.col("ingest_seq") % points.count()))
    return numbered.join(points, "vec_id", "left").drop("vec_id")


def second_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another actor's log: every third clock, with changed texts, and copies of the first actor's every fifth."""
    rows = event_log(spark, sf_dir, actor="b").where("lamport % 3 = 0").withColumn("text", F.concat(F.lit("b"), "text"))
    copies = event_log(spark, sf_dir).where("lamport % 5 = 0").withColumn("text", F.lit("late copy"))
    return rows.unionByName(copies).withColumn("ingest_seq", F.col("ingest_seq") + 10_000_000)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", F.lit("").alias("text"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), (F.col("vec_id") + 1).alias("lamport"))


def first_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


def score() -> Column:
    return F.round("score", 6).alias("score")


ELOG = """elog AS (
  SELECT user_id::VARCHAR AS id, event_id + 1 AS lamport, 'a' AS actor_id, event_type = 'error' AS tombstone, props AS text, event_type, event_id AS ingest_seq,
         CASE WHEN event_type <> 'error' THEN event_id % (SELECT count(*) FROM embeddings) END AS vec_id
  FROM events
)"""
BOTH = f"""{ELOG}, elog2 AS (
  SELECT id, lamport, 'b' AS actor_id, tombstone, 'b' || text AS text, event_type, ingest_seq + 10000000 AS ingest_seq FROM elog WHERE lamport % 3 = 0
  UNION ALL SELECT id, lamport, 'a', tombstone, 'late copy', event_type, ingest_seq + 10000000 FROM elog WHERE lamport % 5 = 0
), merged AS (
  SELECT * FROM (SELECT id, lamport, actor_id, tombstone, text, ingest_seq FROM elog UNION ALL SELECT id, lamport, actor_id, tombstone, text, ingest_seq FROM elog2)
  QUALIFY row_number() OVER (PARTITION BY id, lamport, actor_id ORDER BY ingest_seq) = 1
)"""
LATEST = "QUALIFY row_number() OVER (PARTITION BY id ORDER BY lamport DESC, actor_id DESC) = 1"
DOT = "round(list_inner_product(x.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
FIRST = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


@query(f"WITH {ELOG} SELECT id, lamport, actor_id, tombstone, text, event_type FROM elog")
def scan_log(spark, sf_dir):
    return event_log(spark, sf_dir).select("id", "lamport", "actor_id", "tombstone", "text", F.col("metadata")["event_type"].alias("event_type"))


@query("SELECT vec_id::VARCHAR AS id, label % 3 = 0 AS no_metadata, vec_id % 4 = 0 AS no_embedding FROM embeddings")
def put_normalized(spark, sf_dir):
    from tidemark.schema import checked, normalised

    empty = F.create_map().cast("map<string,string>")
    rows = vectors(spark, sf_dir).withColumns({
        "metadata": F.when(F.col("metadata")["label"].cast("int") % 3 == 0, empty).otherwise(F.col("metadata")), "embedding": F.when(F.col("id").cast("bigint") % 4 == 0, F.array().cast("array<float>")).otherwise(F.col("embedding")),
        "collection": F.lit("vecs"), "actor_id": F.lit("a"), "wall_clock": F.lit(None).cast("timestamp"), "tombstone": F.lit(False), "ingest_seq": F.col("lamport"),
    })
    return checked(normalised(rows), 64).select("id", F.col("metadata").isNull().alias("no_metadata"), F.col("embedding").isNull().alias("no_embedding"))


@query(f"WITH {ELOG} SELECT lamport, actor_id, tombstone, text FROM elog WHERE id = '3'")
def history_by_id(spark, sf_dir):
    return log.history(event_log(spark, sf_dir), "3").select("lamport", "actor_id", "tombstone", "text")


@query(f"WITH {BOTH} SELECT id, lamport // 1000000 AS part, count(*) AS n, string_agg(lamport || actor_id, ',' ORDER BY lamport, actor_id) AS versions FROM merged GROUP BY id, part")
def history_grouped(spark, sf_dir):
    both = merge.crdt_merge(event_log(spark, sf_dir), second_log(spark, sf_dir))
    joined = F.array_join(F.transform("versions", lambda v: F.concat(v["lamport"].cast("string"), v["actor_id"])), ",")
    return log.grouped_history(both).select("id", "part", F.size("versions").cast("bigint").alias("n"), joined.alias("versions"))


@query(f"WITH {BOTH} SELECT id, lamport, actor_id, tombstone, text FROM merged {LATEST}")
def latest_per_id(spark, sf_dir):
    return log.latest(event_log(spark, sf_dir).unionByName(second_log(spark, sf_dir))).select("id", "lamport", "actor_id", "tombstone", "text")


@query(f"WITH {ELOG}, l AS (SELECT * FROM elog {LATEST}) SELECT id, lamport, text FROM l WHERE NOT tombstone")
def live_rows(spark, sf_dir):
    return log.live(event_log(spark, sf_dir)).select("id", "lamport", "text")


@query(f"""WITH {ELOG} SELECT id, lamport, CASE WHEN tombstone THEN last_value(CASE WHEN NOT tombstone THEN text END IGNORE NULLS)
  OVER (PARTITION BY id ORDER BY lamport, actor_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE text END AS text FROM elog""")
def delete_carry_forward(spark, sf_dir):
    return log.carried_forward(event_log(spark, sf_dir), ("text",)).select("id", "lamport", "text")


@query(f"""WITH {ELOG}, gone AS (SELECT DISTINCT id FROM elog WHERE id::BIGINT % 7 = 0 UNION SELECT 'unknown'), l AS (SELECT id, text FROM elog {LATEST})
  SELECT g.id, coalesce(l.text, '') AS text, (SELECT max(lamport) FROM elog) + row_number() OVER (ORDER BY g.id) AS lamport, TRUE AS tombstone FROM gone g LEFT JOIN l ON g.id = l.id""")
def delete_batch(spark, sf_dir):
    rows = event_log(spark, sf_dir)
    ids = rows.where("CAST(id AS bigint) % 7 = 0").select("id").distinct().union(spark.createDataFrame([("unknown",)], "id string"))
    clock = log.latest_clock(rows).first()["clock"]
    return log.deletions(rows, log.numbered(ids, "id", "seq").withColumn("collection", F.lit("events")), clock + 1, "a").select("id", "text", "lamport", "tombstone")


@query(f"WITH {ELOG} SELECT id, lamport FROM (SELECT *, lag(tombstone) OVER (PARTITION BY id ORDER BY lamport, actor_id) AS after FROM elog) WHERE after AND NOT tombstone")
def revive_after_delete(spark, sf_dir):
    return log.revived(event_log(spark, sf_dir)).select("id", "lamport")


@query(f"WITH {ELOG}, l AS (SELECT * FROM elog WHERE lamport <= 500 {LATEST}) SELECT id, lamport, text FROM l WHERE NOT tombstone")
def as_of_latest(spark, sf_dir):
    return log.live(event_log(spark, sf_dir), 500).select("id", "lamport", "text")


@query(f"WITH {ELOG} SELECT lamport, tombstone, text FROM elog WHERE id = '3' AND lamport <= 700")
def as_of_history(spark, sf_dir):
    return log.history(log.as_of(event_log(spark, sf_dir), 700), "3").select("lamport", "tombstone", "text")


@query(f"WITH {BOTH} SELECT id, lamport, actor_id, text FROM merged WHERE actor_id = 'a'")
def dedup_versions(spark, sf_dir):
    copies = second_log(spark, sf_dir).where("actor_id = 'a'")
    return log.dedup(copies.unionByName(event_log(spark, sf_dir))).select("id", "lamport", "actor_id", "text")


@query(f"WITH {BOTH} SELECT id, lamport, actor_id, tombstone, text FROM merged")
def crdt_merge_two_actors(spark, sf_dir):
    return merge.crdt_merge(second_log(spark, sf_dir), event_log(spark, sf_dir)).select("id", "lamport", "actor_id", "tombstone", "text")


@query(f"""WITH {BOTH} SELECT id, lamport, actor_id FROM (SELECT DISTINCT id, lamport, actor_id FROM elog2)
  ANTI JOIN elog USING (id, lamport, actor_id)""")
def unseen_versions(spark, sf_dir):
    return merge.unseen(event_log(spark, sf_dir), second_log(spark, sf_dir)).select("id", "lamport", "actor_id")


@query(f"WITH {ELOG} SELECT ingest_seq, max((lamport * 7919) % 10007) OVER (ORDER BY ingest_seq) AS clock FROM elog")
def lamport_witness(spark, sf_dir):
    rows = event_log(spark, sf_dir).withColumn("lamport", F.col("lamport") * 7919 % 10007)
    return log.witnessed(rows, block=1000).select("ingest_seq", "clock")


@query(f"WITH {ELOG} SELECT 'events' AS collection, max(lamport) AS clock FROM elog")
def latest_clock(spark, sf_dir):
    return log.latest_clock(event_log(spark, sf_dir))


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) + 99 AS lamport FROM events")
def assign_clocks(spark, sf_dir):
    return log.numbered(read(spark, sf_dir, "events").select("event_id"), "event_id", "lamport", 100)


@query(f"SELECT vec_id::VARCHAR AS id, {DOT} AS score, vec_id + 1 AS version FROM embeddings x, (SELECT {FIRST} AS embedding) q ORDER BY list_inner_product(x.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, id LIMIT 10")
def search_topk(spark, sf_dir):
    return search.top_k(vectors(spark, sf_dir), first_vector(spark, sf_dir), 10).select("id", score(), "version")


def _event_search(where: str, clock: str = "TRUE") -> str:
    return f"""WITH {ELOG}, l AS (SELECT * FROM elog WHERE {clock} {LATEST})
      SELECT id, {DOT} AS score, lamport AS version FROM l JOIN embeddings x USING (vec_id), (SELECT {FIRST} AS embedding) q
      WHERE NOT tombstone AND {where} ORDER BY list_inner_product(x.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, id LIMIT 10"""


def _event_hits(spark, sf_dir, *filters, clock=None):
    return search.search(event_log(spark, sf_dir, vectors=True), first_vector(spark, sf_dir), 10, *filters, clock=clock).select("id", score(), "version")


@query(_event_search("TRUE", "lamport <= 600"))
def search_topk_asof(spark, sf_dir):
    return _event_hits(spark, sf_dir, clock=600)


@query(_event_search("TRUE"))
def search_after_delete(spark, sf_dir):
    return _event_hits(spark, sf_dir)


@query(_event_search("event_type = 'click'"))
def search_filtered(spark, sf_dir):
    return _event_hits(spark, sf_dir, meta_eq("event_type", "click"))


@query(_event_search("event_type = 'click' AND lamport % 3 = 1"))
def search_multi_filter(spark, sf_dir):
    rows = event_log(spark, sf_dir, vectors=True)
    banded = rows.withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("band"), (F.col("lamport") % 3).cast("string"))))
    hits = search.search(banded, first_vector(spark, sf_dir), 10, meta_eq("event_type", "click"), meta_eq("band", "1"))
    return hits.select("id", score(), "version")


@query(_event_search("event_type = 'view'"))
def search_missing_key(spark, sf_dir):
    return _event_hits(spark, sf_dir, meta_eq("event_type", "view"), meta_eq("absent", ""))


@query("SELECT vec_id::VARCHAR AS id, label <> 2 AND label = 1 AS one, label <> 2 AS missing FROM embeddings")
def filter_semantics(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("metadata", F.when(F.col("metadata")["label"] != "2", F.col("metadata")))
    return rows.select("id", all_of(meta_eq("label", "1")).alias("one"), meta_eq("absent", "").alias("missing"))


@query(f"""SELECT q.vec_id AS query_id, x.vec_id::VARCHAR AS id, {DOT} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(x.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, x.vec_id::VARCHAR)::INTEGER AS rank
  FROM embeddings x, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q QUALIFY rank <= 10""")
def batch_search(spark, sf_dir):
    queries = read(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.batch_top_k(vectors(spark, sf_dir), queries, 10).select("query_id", "id", score(), "rank")


OWNER = """list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(0, 5 + length(vec_id::VARCHAR)), lambda i: CASE WHEN i < 4 THEN unicode('vecs'[i + 1]) WHEN i = 4 THEN 0 ELSE unicode((vec_id::VARCHAR)[i - 4]) END::UHUGEINT)),
  lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"""
MEMBERS = ["local://one", "host-b:7000", "host-a:7000", "host-a:7000", ""]


@query(f"SELECT (['host-a:7000', 'host-b:7000', 'local://one'])[({OWNER} % 3)::INTEGER + 1] AS owner, count(*) AS n FROM embeddings GROUP BY 1")
def shard_owner_counts(spark, sf_dir):
    owned = read(spark, sf_dir, "embeddings").select(merge.owner_of(F.lit("vecs"), F.col("vec_id").cast("string"), MEMBERS).alias("owner"))
    return owned.groupBy("owner").agg(F.count("*").alias("n"))


@query(f"""WITH hits AS (SELECT vec_id::VARCHAR AS id, list_inner_product(x.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s, vec_id, m FROM embeddings x, (SELECT {FIRST} AS embedding) q, range(3) t(m)
    WHERE vec_id % 3 = m OR (m = 0 AND vec_id % 5 = 0)),
  shard AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY m ORDER BY s DESC, id) <= 10)
  SELECT id, round(max(s), 6) AS score, max(vec_id + 1 + m * 100000) AS version FROM shard GROUP BY id ORDER BY max(s) DESC, id LIMIT 10""")
def federated_merge(spark, sf_dir):
    rows, first = vectors(spark, sf_dir), first_vector(spark, sf_dir)
    number = F.col("id").cast("bigint")
    members = F.array_distinct(F.array_compact(F.array((number % 3).cast("int"), F.when(number % 5 == 0, 0))))
    dealt = rows.withColumn("member", F.explode(members)).withColumn("lamport", F.col("lamport") + F.col("member") * 100_000)
    return merge.merge_shards(search.scored(dealt, first, more=("member",)), 10).select("id", score(), "version")


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]+', ' ', 'g')) AS normal FROM documents")
def normalized_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", embed.normal_text(F.col("text")).alias("normal"))


WORDS = "list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]+', ' ', 'g')), ' '), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), f AS (
    SELECT doc_id, 'w:' || unnest(w) AS feature FROM w UNION ALL
    SELECT doc_id, 'p:' || a || '_' || b FROM (SELECT doc_id, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM w WHERE len(w) > 1))
  SELECT doc_id, feature, count(*) AS n FROM f GROUP BY ALL""")
def text_features(spark, sf_dir):
    features = embed.feature_rows(by_document(read(spark, sf_dir, "documents")), embed.normal_text(F.col("text")), "doc_id")
    return features.groupBy("doc_id", "feature").agg(F.count("*").alias("n"))


FOLD = """list_reduce(list_prepend(1469598103934665603::UHUGEINT, list_transform(string_split(feature, ''), lambda c: unicode(c)::UHUGEINT)),
  lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"""


@query(f"""WITH w AS (SELECT {WORDS} AS w FROM documents), f AS (SELECT DISTINCT 'w:' || unnest(w) AS feature FROM w)
  SELECT feature, ({FOLD} // 4294967296)::BIGINT AS high, ({FOLD} % 4294967296)::BIGINT AS low FROM f""")
def feature_hashes(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.split(embed.normal_text(F.col("text")), " ")).alias("word")).where("word <> ''").select(F.concat(F.lit("w:"), "word").alias("feature")).distinct()
    high, low = merge.fnv1a(F.transform(F.split("feature", ""), F.ascii), embed.OFFSET)
    return words.select("feature", high.alias("high"), low.alias("low"))


SPLIT = """list_reduce(list_prepend(state, list_transform([1, 2, 3, 4][:{k}], lambda n: n::UHUGEINT)), lambda h, k: list_transform([(h + k * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT],
  lambda a: list_transform([(xor(a, a // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT],
  lambda b: list_transform([(xor(b, b // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT], lambda c: xor(c, c // 2147483648::UHUGEINT))[1])[1])[1])"""


@query(f"""WITH w AS (SELECT {WORDS} AS w FROM documents), f AS (
    SELECT 'w:' || unnest(w) AS feature FROM w UNION SELECT 'p:' || a || '_' || b FROM (SELECT unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM w WHERE len(w) > 1)),
  s AS (SELECT feature, {FOLD} AS state FROM f)
  SELECT feature, {", ".join(f"({SPLIT.format(k=k)} % 384)::BIGINT AS b{k}" for k in range(1, 5))} FROM s""")
def feature_buckets(spark, sf_dir):
    """The buckets that each different word and pair is added to."""
    features = embed.feature_rows(read(spark, sf_dir, "documents"), embed.normal_text(F.col("text"))).distinct()
    return features.select("feature", embed.feature_buckets(F.col("feature")).alias("b")).select("feature", *[F.col("b")[k].alias(f"b{k + 1}") for k in range(4)])


@query()
def text_search_ids(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), embed.encoded(F.col("text")).alias("embedding"), "text", F.create_map(F.lit("lang"), "lang").alias("metadata"), (F.col("doc_id") + 1).alias("lamport"))
    question = embed.HashedEmbedding().encode(["the and of to that is"])[0].tolist()
    return search.top_k(docs, question, 10).select("id", score())


@query(f"""WITH {ELOG}, p AS (SELECT lamport, id, tombstone, text FROM elog WHERE lamport > 100 ORDER BY lamport LIMIT 250)
  SELECT *, (SELECT count(*) FROM elog WHERE lamport > 100) > 250 AS has_more FROM p""")
def pull_page(spark, sf_dir):
    return replicate.pull_page(event_log(spark, sf_dir).select("lamport", "actor_id", "id", "tombstone", "text"), 100, 250).drop("actor_id")


@query(f"WITH {BOTH} SELECT id, lamport, actor_id, tombstone, text FROM merged")
def recover_snapshot_tail(spark, sf_dir):
    whole = merge.crdt_merge(event_log(spark, sf_dir), second_log(spark, sf_dir))
    snapshot, tail = log.as_of(whole, 400), merge.unseen(log.as_of(whole, 400), whole)
    return snapshot.unionByName(tail).select("id", "lamport", "actor_id", "tombstone", "text")


@query("SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[ \\t\\n\\r.,!?;:\"''()\\[\\]{}\\-/\\\\@#$%^&*+=<>|~`]|[^ \\t\\n\\r.,!?;:\"''()\\[\\]{}\\-/\\\\@#$%^&*+=<>|~`]+')) AS word FROM documents) GROUP BY ALL")
def pretokenize_simple(spark, sf_dir):
    words = by_document(read(spark, sf_dir, "documents")).select("doc_id", F.explode(tokenize.simple_words(F.col("text"))).alias("word"))
    return words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query(f"""WITH {ELOG}, l AS (SELECT * FROM elog {LATEST})
  SELECT 'events' AS collection, count(*) AS versions, count(DISTINCT id) AS ids, (SELECT count(*) FROM l WHERE NOT tombstone) AS live, max(lamport) AS clock FROM elog""")
def collection_stats(spark, sf_dir):
    last = log.latest(event_log(spark, sf_dir)).groupBy("collection").agg(F.count("*").alias("ids"), F.count_if(~F.col("tombstone")).alias("live"))
    totals = log.dedup(event_log(spark, sf_dir)).groupBy("collection").agg(F.count("*").alias("versions"), F.max("lamport").alias("clock"))
    return totals.join(last, "collection").select("collection", "versions", "ids", "live", "clock")


@query(f"WITH {ELOG} SELECT id, lamport, text FROM elog WHERE lamport > 600")
def log_tail(spark, sf_dir):
    return event_log(spark, sf_dir).where("lamport > 600").select("id", "lamport", "text")


@query(f"""WITH {ELOG} SELECT lamport, '{{"event_type":"' || event_type || '"}}' AS metadata FROM elog""")
def metadata_json(spark, sf_dir):
    return event_log(spark, sf_dir).select("lamport", F.to_json("metadata").alias("metadata"))


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(search.inner_product(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


def new_database(spark: SparkSession) -> Database:
    """An empty database of vectors alone in a folder of its own."""
    return Database(spark, new_folder(spark, "database"), make=None, actor="a")


def put_vectors(spark, sf_dir, db: Database, where: str) -> None:
    rows = read(spark, sf_dir, "embeddings").where(where)
    db.collection("vecs", bits=4).put(rows.select(F.col("vec_id").cast("string").alias("id"), "embedding", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), "vec_id"), order="vec_id")


@query("""WITH puts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id % 2, vec_id) AS lamport FROM embeddings),
    gone AS (SELECT vec_id, (SELECT count(*) FROM embeddings) + row_number() OVER (ORDER BY vec_id::VARCHAR) AS lamport FROM embeddings WHERE vec_id % 10 = 0)
  SELECT vec_id::VARCHAR AS id, lamport, FALSE AS tombstone FROM puts UNION ALL SELECT vec_id::VARCHAR, lamport, TRUE FROM gone""")
def database_recovery(spark, sf_dir):
    """Snapshot, later writes, another snapshot and deletes, read by another handle."""
    db = new_database(spark)
    put_vectors(spark, sf_dir, db, "vec_id % 2 = 0")
    db.snapshot()
    put_vectors(spark, sf_dir, db, "vec_id % 2 = 1")
    db.snapshot()
    db.collection("vecs").delete(read(spark, sf_dir, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").cast("string").alias("id")))
    return Database(spark, db.path, make=None).collection("vecs").versions().select("id", "lamport", "tombstone")


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings WHERE vec_id % 2 = 0)
  SELECT vec_id::VARCHAR AS id, n + row_number() OVER (ORDER BY vec_id) AS lamport FROM embeddings, n WHERE vec_id % 3 = 0""")
def database_drop(spark, sf_dir):
    """A dropped collection of the same name begins empty, with later clocks."""
    db = new_database(spark)
    put_vectors(spark, sf_dir, db, "vec_id % 2 = 0")
    db.drop("vecs")
    db.snapshot()
    put_vectors(spark, sf_dir, db, "vec_id % 3 = 0")
    return db.collection("vecs").live().select("id", "lamport")


@query(f"""WITH hits AS (SELECT vec_id, label, {DOT} AS score, list_inner_product(x.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings x, (SELECT {FIRST} AS embedding) q WHERE vec_id % 10 <> 5)
  SELECT vec_id::VARCHAR AS id, score FROM hits ORDER BY s DESC, vec_id::VARCHAR LIMIT 10""")
def quantized_search(spark, sf_dir):
    """The exact best 10 among the best 200 by quantized scores, over a snapshot and later deletes."""
    db = new_database(spark)
    put_vectors(spark, sf_dir, db, "TRUE")
    db.snapshot()
    db.collection("vecs").delete(read(spark, sf_dir, "embeddings").where("vec_id % 10 = 5").select(F.col("vec_id").cast("string").alias("id")))
    return db.collection("vecs").search_quantized(first_vector(spark, sf_dir), 10, among=200).select("id", score())


@query()
def quantized_topk(spark, sf_dir):
    table = quantize.quantized(vectors(spark, sf_dir), 64, bits=4, seed=77)
    return quantize.quantized_top_k(table, first_vector(spark, sf_dir), 10, bits=4, seed=77).select("id", score())


@query()
def bpe_encode(spark, sf_dir):
    tokenizer = tokenize.Tokenizer({t: i for i, t in enumerate([*"abcdefghijklmnopqrstuvwxyz .,", "th", "the", "an", "and", "in", "on", "er"])} | {"[CLS]": 100, "[SEP]": 101, "[PAD]": 102, "[UNK]": 103}, [("t", "h"), ("th", "e"), ("a", "n"), ("an", "d"), ("i", "n"), ("o", "n"), ("e", "r")])
    ids = read(spark, sf_dir, "documents").select("doc_id", tokenize.encoded_ids(F.col("text"), tokenizer).alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("n"), F.crc32(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")).alias("crc"))


@query(f"WITH {ELOG} SELECT id, lamport, actor_id, text FROM elog")
def replicate_once(spark, sf_dir):
    """Two appends, a follower that sees both, and a run with nothing new."""
    folder = new_folder(spark, "replica")
    rows = event_log(spark, sf_dir)
    for part in (rows.where("lamport % 2 = 0"), rows.where("lamport % 2 = 1 OR lamport % 4 = 0")):
        part.write.mode("append").partitionBy("collection").parquet(f"{folder}/log")
        replicate.follow(spark, f"{folder}/log", f"{folder}/copy", f"{folder}/progress").awaitTermination()
    replicate.follow(spark, f"{folder}/log", f"{folder}/copy", f"{folder}/progress").awaitTermination()
    return replicate.stored(spark, f"{folder}/copy").select("id", "lamport", "actor_id", "text")


def recall(rows: int = 200, dim: int = 64, bits: int = 4, k: int = 10, queries: int = 100, seed: int = 77) -> float:
    """Mean share of the exact best ``k`` among the quantized best ``k``, on uniform random vectors."""
    random = np.random.default_rng(seed)
    x, q = random.uniform(-1, 1, (rows, dim)), random.uniform(-1, 1, (queries, dim))
    model = quantize.quantizer(dim, bits, seed)
    estimated = model.scores(q, *model.encode(x))
    best = lambda s: [set(np.argsort(-r, kind="stable")[:k]) for r in s]
    return float(np.mean([len(a & b) / k for a, b in zip(best(q @ x.T), best(estimated))]))
