"""Views of the version log.

Versions of an id are ordered by (lamport, actor_id); of versions with one (id, lamport, actor_id) the
first that arrived counts. Greatest clocks are found on keys alone and combined before the shuffle;
the rows then meet them by (id, clock). What looks at earlier versions runs over blocks of clocks, and
only the blocks' ends are scanned in one run. So an id with a third of all rows does not fill one task.
Ids are never null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["collection", "id"]
#: Clocks in a block; rows in a range of ``numbered``, for up to 1000 ranges and beyond.
BLOCK, RANGE_ROWS, MOST_ROWS = 1_000_000, 100_000, 5_000_000


def _row(log: DataFrame) -> Column:
    return F.struct(*log.columns)


def dedup(log: DataFrame) -> DataFrame:
    """One row for each (collection, id, lamport, actor_id): the first by ``ingest_seq``."""
    return log.groupBy(*KEY, "lamport", "actor_id").agg(F.min_by(_row(log), "ingest_seq").alias("v")).select("v.*")


def as_of(log: DataFrame, clock: int) -> DataFrame:
    """What had been written up to a clock; the predicate reaches the scan."""
    return log.where(F.col("lamport") <= clock)


def latest(log: DataFrame) -> DataFrame:
    """The latest version of each id, tombstones included; repeated versions do no harm."""
    tops = log.groupBy(*KEY).agg(F.max("lamport").alias("lamport"))
    last = log.join(tops, [*KEY, "lamport"], "left_semi")
    order = F.struct("actor_id", (-F.col("ingest_seq")).alias("first"))
    return last.groupBy(*KEY, "lamport").agg(F.max_by(_row(log), order).alias("v")).select("v.*")


def live(log: DataFrame, clock: int | None = None) -> DataFrame:
    """The latest versions that are no tombstones, now or as of a clock."""
    return latest(log if clock is None else as_of(log, clock)).where(~F.col("tombstone"))


def history(log: DataFrame, id: str) -> DataFrame:
    """All versions of an id in order; the predicate reaches the scan."""
    return dedup(log.where(F.col("id") == id)).orderBy("lamport", "actor_id")


def grouped_history(log: DataFrame, *columns: str, block: int = BLOCK) -> DataFrame:
    """For each id the ordered arrays of its versions (lamport, actor_id and ``columns``), one array for each ``part``, a block of clocks."""
    version = F.struct("lamport", "actor_id", *columns)
    part = F.floor(F.col("lamport") / block).alias("part")
    return dedup(log).groupBy(*KEY, part).agg(F.sort_array(F.collect_list(version)).alias("versions"))


def deletions(log: DataFrame, ids: DataFrame, first_clock: int, actor: str) -> DataFrame:
    """Tombstones for ``ids`` (``collection``, ``id``, ``seq``), known or not.

    They carry the text and metadata of the latest version on, and take clocks from ``first_clock``
    in order of ``seq``, which must count from 0.
    """
    last = latest(log).select(*KEY, "text", "metadata")
    return ids.join(last, KEY, "left").select(
        *KEY, F.lit(None).cast("array<float>").alias("embedding"), F.coalesce("text", F.lit("")).alias("text"), "metadata", (F.col("seq") + first_clock).alias("lamport"),
        F.lit(actor).alias("actor_id"), F.current_timestamp().alias("wall_clock"), F.lit(True).alias("tombstone"), (F.col("seq") + first_clock).alias("ingest_seq"),
    )


def _before(*partition: str) -> Window:
    return Window.partitionBy(*partition).orderBy("lamport", "actor_id")


def _blocked(log: DataFrame, block: int, ends: dict[str, Column]) -> DataFrame:
    """``log`` with its ``block`` and, as ``earlier``, the last non-null ``ends`` of the blocks before it."""
    blocked = log.withColumn("block", F.floor(F.col("lamport") / block))
    found = blocked.groupBy(*KEY, "block").agg(*[c.alias(name) for name, c in ends.items()])
    before = Window.partitionBy(*KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = found.select(*KEY, "block", F.struct(*[F.last(name, True).over(before).alias(name) for name in ends]).alias("earlier"))
    return blocked.join(earlier, [*KEY, "block"])


def carried_forward(log: DataFrame, columns: tuple[str, ...] = ("text", "metadata"), block: int = BLOCK) -> DataFrame:
    """Tombstones with the last non-null values of earlier versions in place of their own."""
    order = F.struct("lamport", "actor_id")
    own = lambda c: F.when(~F.col("tombstone"), F.col(c))
    blocked = _blocked(log, block, {c: F.max_by(c, F.when(own(c).isNotNull(), order)) for c in columns})
    inside = _before(*KEY, "block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda c: F.coalesce(F.last(own(c), True).over(inside), F.col(f"earlier.{c}"))
    return blocked.withColumns({c: F.when(F.col("tombstone"), carried(c)).otherwise(F.col(c)) for c in columns}).select(*log.columns)


def revived(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """Versions that follow a tombstone of their id and are none."""
    blocked = _blocked(log, block, {"tombstone": F.max_by("tombstone", F.struct("lamport", "actor_id"))})
    after = F.coalesce(F.lag("tombstone").over(_before(*KEY, "block")), F.col("earlier.tombstone"))
    return blocked.withColumn("after", after).where(F.col("after") & ~F.col("tombstone")).select(*log.columns)


def latest_clock(log: DataFrame) -> DataFrame:
    """The greatest clock of each collection."""
    return log.groupBy("collection").agg(F.max("lamport").alias("clock"))


def witnessed(log: DataFrame, block: int = 50_000) -> DataFrame:
    """Each row with ``clock``, the greatest clock seen up to it in its collection's order of arrival.

    Runs over blocks of ``ingest_seq`` in parallel; only the blocks' maxima are scanned in one run.
    """
    blocked = log.withColumn("block", F.floor(F.col("ingest_seq") / block))
    maxima = blocked.groupBy("collection", "block").agg(F.max("lamport").alias("m"))
    earlier = maxima.select("collection", "block", F.max("m").over(Window.partitionBy("collection").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    inside = F.max("lamport").over(Window.partitionBy("collection", "block").orderBy("ingest_seq").rowsBetween(Window.unboundedPreceding, 0))
    return blocked.withColumn("inside", inside).join(earlier, ["collection", "block"]).withColumn("clock", F.greatest("inside", "earlier")).drop("block", "inside", "earlier")


def row_hash(rows: DataFrame) -> Column:
    """A hash of whole rows; maps count by their JSON."""
    return F.xxhash64(*[F.to_json(f.name) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in rows.schema])


def numbered(rows: DataFrame, order: str, name: str, first: int = 0, ranges: int | None = None) -> DataFrame:
    """``rows`` numbered from ``first`` by an ascending column, without a task that sees all rows.

    Rows of one value follow each other by a hash of the row, so the numbers do not change when they are
    computed again. Rows are dealt into ranges, more of them the more rows there are, cut at quantiles
    of a sample of some 20 values a range; a range starts where the counts before it end.
    """
    total = rows.count()
    ranges = ranges or max(1, min(1000, total // RANGE_ROWS), total // MOST_ROWS)
    keyed = rows.withColumn("tie", row_hash(rows))
    sampled = F.pmod(F.xxhash64(order, "tie"), F.lit(1_000_003)) <= 1_000_003 * min(1.0, 20 * ranges / max(1, total))
    sample = sorted(map(tuple, keyed.where(sampled & F.col(order).isNotNull()).select(order, "tie").distinct().collect()))
    cuts = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []
    own = F.struct(F.col(order).alias("value"), F.col("tie"))
    place = F.size(F.filter(F.array(*[F.struct(F.lit(v).alias("value"), F.lit(t).cast("bigint").alias("tie")) for v, t in cuts]), lambda c: c <= own)) if cuts else F.lit(0)
    dealt = keyed.withColumn("deal", place)
    counts = {r["deal"]: r["count"] for r in dealt.groupBy("deal").count().collect()}  # a row for each range
    starts, total = [], first
    for k in range(max(counts, default=0) + 1):
        starts.append(total)
        total += counts.get(k, 0)
    number = F.row_number().over(Window.partitionBy("deal").orderBy(order, "tie")) - 1
    return dealt.withColumn(name, number + F.get(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col("deal"))).drop("deal", "tie")
