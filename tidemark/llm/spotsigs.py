"""SpotSigs document fingerprints, by DataFrame functions alone.

A spot is a common word of the text's languages (its anchor) with the chain of the next ``2``
content words, common words between them passed over; the last of several common words in a row is
the anchor. The set of a text's spots is its signature set, a digest of the set its fingerprint,
and likeness is the Jaccard similarity of two sets.

For the similarity join, sets are partitioned by length: sets whose lengths differ by more than
the threshold allows can't be alike, so only lengths of the same or the next class meet. Within
these, sets that share none of their rarest spots are pruned, and the rest is verified exactly.
Where only the number of links is asked for, near copies of one text are counted as a group.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import HOT, cut, free_name, join_hot, let, text_or_empty

#: Fixed: common words that serve as anchors.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which will with you "
    "als am auch auf aus bei das dem den der des die ein eine einen einer es für hat ich im ist mit nach nicht noch oder sich sie sind so und von war wie wird zu zum zur "
    "al ante como con de del el en entre es esta este la las lo los más no o para pero por que se si sin sobre su sus un una y "
    "au aux avec ce ces dans des du elle et il je la le les leur lui mais ne nous ou où par pas pour qui sa se ses son sont sur une vous"
).split()
THRESHOLD = 0.8
#: Text in a range of ids, and the most ranges (a place is found in two steps, in groups of 512).
RANGE_BYTES, MOST_RANGES, GROUP = 32_000_000, 1 << 18, 512
#: Sets with one spot that a task of the join holds against all others with it.
BLOCK = 2000
#: Near copies are counted as a group from so many on; spots of at most so many sets are compared pair by pair inside; most edits of a member.
GROUPED, RARE, MOST_EDITS = 32, 16, 12


def anchor_pattern() -> str:
    """A common word before a space, as a whole; alternatives are grouped by their first letter."""
    groups: dict[str, set[str]] = {}
    for word in ANCHORS:
        groups.setdefault(word[0], set()).add(word[1:])
    return "(?<![^ ])(" + "|".join(f"{first}(?:{'|'.join(sorted(rest, key=len))})" for first, rest in sorted(groups.items())) + ") "


def signatures(text: Column) -> Column:
    """The sorted set of a text's spots (``anchor~word~word``); of a text without a spot, ``=`` and a digest of the text."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " "))
    tied = F.split(F.regexp_replace(words, anchor_pattern(), "$1~"), " ")

    def spot(token: Column, after: Column) -> Column:
        return F.when(F.contains(token, F.lit("~")) & after.isNotNull(), F.concat(F.substring_index(token, "~", -2), F.lit("~"), F.substring_index(after, "~", -1)))

    spots = let(tied, lambda t: F.sort_array(F.array_distinct(F.array_compact(F.zip_with(t, F.slice(t, F.lit(2), F.size(t)), spot)))))
    return let(spots, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.concat(F.lit("="), F.sha2(text, 256)))))


def fingerprint(spots: Column) -> Column:
    return F.sha2(F.array_join(spots, ","), 256)


def likeness(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 unread where their lengths put it below ``threshold``."""
    exact = let(F.size(F.array_intersect(a, b)), lambda shared: shared / (F.size(a) + F.size(b) - shared))
    return F.when(F.least(F.size(a), F.size(b)) < threshold * F.greatest(F.size(a), F.size(b)), 0.0).otherwise(exact)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``spots`` and ``fingerprint`` of each row.

    A null text counts as empty, an empty text or one without spots has the hash of the text as its
    only spot, repeated rows and null ids stay, other columns are not read.
    """
    return docs.select(F.col(id_col).alias("doc_id"), signatures(text_or_empty(text_col)).alias("spots")).withColumn("fingerprint", fingerprint(F.col("spots")))


def _sets(prints: DataFrame) -> DataFrame:
    """Each different signature set once, under a number: ``set``, ``fingerprint``, ``n_rows`` and its spots as 64-bit hashes."""
    hashed = prints.select("fingerprint", F.transform("spots", lambda x: F.xxhash64(x)).alias("spots"))
    found = hashed.groupBy("fingerprint").agg(F.count("*").alias("n_rows"), F.first("spots").alias("spots"))
    return cut(found.select(F.monotonically_increasing_id().alias("set"), "fingerprint", "n_rows", "spots"))


def _shared_spots(spots: DataFrame, total: int) -> DataFrame:
    """``set``, ``spot`` and ``count``, the number of sets with the spot, where that is over 1.

    Spots in over a ``HOT``-th of the ``total`` rows are few, whatever the size of the table; they are
    found by way of 65,536 buckets, counted apart and sent to all tasks. The others are shuffled once.
    """
    bucketed = spots.withColumn("bucket", F.pmod("spot", F.lit(1 << 16)))
    full = bucketed.groupBy("bucket").count().where(F.col("count") * HOT > total).select("bucket")
    hot = cut(bucketed.join(F.broadcast(full), "bucket").groupBy("spot").count().where(F.col("count") * HOT > total))
    usual = spots.join(F.broadcast(hot.select("spot")), "spot", "left_anti")
    counted = usual.withColumn("count", F.count("*").over(Window.partitionBy("spot")))
    return counted.unionByName(spots.join(F.broadcast(hot), "spot")).where("count > 1")


def _possible(sets: DataFrame, threshold: float) -> DataFrame:
    """The sets that may be alike to another one, as far as half of all spots tell (those with an even hash).

    A set that is alike to another shares all but a part of its spots, so one with more spots of its own than that
    part has no links. The ids that stay are sent to all tasks as bits, 64 sets a row.
    """
    even = sets.select("set", F.size("spots").alias("n"), F.filter("spots", lambda s: s % 2 == 0).alias("half"))
    halves = even.select("set", F.explode("half").alias("spot"))
    shared = _shared_spots(halves, even.agg(F.sum(F.size("half"))).first()[0] or 0).groupBy("set").agg(F.count("*").alias("shared"))
    own = F.col("size") - F.coalesce("shared", F.lit(0))
    some = even.select("set", "n", F.size("half").alias("size")).join(shared, "set", "left").where(own <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9))
    word, bit = F.shiftright("set", 6), F.expr("shiftleft(1L, cast(set & 63 as int))")
    bits = cut(some.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")))
    return sets.join(F.broadcast(bits), word == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def _ordered(sets: DataFrame, threshold: float) -> DataFrame:
    """``set``, its size ``n``, ``shared``, its spots that other sets have too, rarest first, and ``room``, how many of these are to be joined.

    Spots that only one set has come first in the order of rarity and can't be shared, so they only take
    up places at the start of a set, and neither the join nor the check needs to see them.
    """
    sizes, spots = sets.select("set", F.size("spots").alias("n")), sets.select("set", F.explode("spots").alias("spot"))
    rare_first = F.sort_array(F.collect_list(F.struct("count", "spot"))).alias("shared")
    shared = _shared_spots(spots, sizes.agg(F.sum("n")).first()[0] or 0).repartition("set").groupBy("set").agg(rare_first).join(sizes, "set")
    n = F.col("n")
    room = n - F.ceil(n * threshold - 1e-9) + 1 - (n - F.size("shared"))
    return cut(shared.withColumn("room", room.cast("int")).where("room > 0"))


def _least(sizes: Column, threshold: float) -> Column:
    """How many spots alike sets of so many in all share at least."""
    return sizes * (threshold / (1 + threshold)) - 1e-9


def _links(ordered: DataFrame, threshold: float) -> DataFrame:
    """Pairs of alike sets by number, ``a`` the smaller set (or the lower number), with their ``likeness``.

    ``ordered`` may have a ``group``; then pairs inside one group are left out, before they are made. Members of a group
    are kept together at each spot, so its members never meet each other, only those of another group or of none.
    At the first spot that two alike sets share, both have enough spots left for all that they must share; where they
    meet at a spot with fewer left, it is not their first or they aren't alike.
    """
    if "group" not in ordered.columns:
        ordered = ordered.withColumn("group", F.lit(None).cast("bigint"))
    n = F.col("n")
    own = F.struct("group", F.when(F.col("group").isNull(), F.col("set")).alias("alone")).alias("own")
    length_class = F.floor(F.log(n.cast("double")) / -math.log(threshold) + 1e-9) if threshold < 1 else n.cast("bigint")
    rarest = ordered.select("set", own, "n", F.size("shared").alias("size"), length_class.alias("class"), F.posexplode(F.slice("shared", F.lit(1), F.col("room"))).alias("place", "s"))
    after = (F.col("size") - 1 - F.col("place")).alias("after")
    rarest = rarest.select("set", "own", "n", "class", "s.spot", F.ceil(F.col("s.count") / BLOCK).alias("blocks"), after)
    key, sets = F.xxhash64("class", "spot", "block").alias("key"), F.collect_list(F.struct("set", "n", "after"))
    early = rarest.where(F.col("after") + 1 >= _least(2 * n, threshold)).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks"))).withColumn("key", key)
    late = rarest.withColumn("class", F.explode(F.array(F.col("class"), F.col("class") - 1))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).withColumn("key", key)
    early = early.repartition("key").groupBy("key", "own").agg(sets.alias("early")).withColumnRenamed("own", "mine")
    late = late.repartition("key").groupBy("key", "own").agg(sets.alias("late"))

    def fits(x: Column, y: Column) -> Column:
        lengths = (y["n"] >= x["n"]) & (x["n"] >= threshold * y["n"] - 1e-9) & ((x["n"] < y["n"]) | (x["set"] < y["set"]))
        return lengths & (F.least(x["after"], y["after"]) + 1 >= _least(x["n"] + y["n"], threshold))

    some = F.filter("early", lambda x: F.exists("late", lambda y: fits(x, y)))
    others = early.join(late, "key").where(~F.col("mine").eqNullSafe(F.col("own")) & (F.size(some) > 0))
    found = others.select(F.explode(some).alias("x"), "late").select("x", F.explode(F.filter("late", lambda y: fits(F.col("x"), y))).alias("y"))
    met = found.select(F.col("x.set").alias("a"), F.col("y.set").alias("b")).distinct()
    spots_of = F.transform("shared", lambda s: s["spot"])
    left, right = ordered.select(F.col("set").alias("a"), "n", spots_of.alias("x")), ordered.select(F.col("set").alias("b"), F.col("n").alias("m"), spots_of.alias("y"))
    both = met.join(left, "a").join(right, "b").select("a", "b", n, "m", F.size(F.array_intersect("x", "y")).alias("common"))
    return both.select("a", "b", (F.col("common") / (n + F.col("m") - F.col("common"))).alias("likeness")).where(F.col("likeness") >= threshold - 1e-12)


def _grouped(ordered: DataFrame, threshold: float) -> DataFrame:
    """``ordered`` with ``group``, null for most sets, and how the sets of a group differ from the spots that most of it has.

    A set's usual spots are those about as frequent as its median one; sets with the same least hash of a usual spot are
    put together, and groups with alike bases (the spots of over half of the members) take the largest one's. ``lack``
    is the number of base spots that the set hasn't, ``base`` the number of all; ``edits`` are these and its frequent other
    spots, ``extra`` its rare ones, of at most ``RARE`` sets. A set with so many edits that their subsets outnumber the
    group has none. Which sets are grouped decides about the work, not about the links.
    """
    middle = F.get("shared", F.floor(F.size("shared") / 2).cast("int"))["count"]
    usual = F.transform(F.filter("shared", lambda s: s["count"] * 2 >= middle), lambda s: s["spot"])
    keyed = ordered.withColumn("first", F.when(middle >= GROUPED, F.array_min(usual)))
    spots = keyed.where("first IS NOT NULL").select("first", F.explode(F.concat(usual, F.array(F.lit(None).cast("bigint")))).alias("spot"))
    counted = spots.groupBy("first", "spot").count().groupBy("first").agg(F.max(F.when(F.col("spot").isNull(), F.col("count"))).alias("size"), F.collect_list(F.struct("spot", "count")).alias("all"))
    most = F.transform(F.filter("all", lambda s: s["spot"].isNotNull() & (s["count"] * 2 > F.col("size"))), lambda s: s["spot"])
    bases = cut(counted.where(F.col("size") >= GROUPED).select("first", "size", most.alias("spots")).where(F.size("spots") > 0))
    alike = _links(_ordered(bases.select(F.col("first").alias("set"), "spots"), threshold), threshold).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    sizes = bases.select(F.col("first").alias("b"), "size")
    larger = alike.select("p.a", "p.b").join(sizes, "b").groupBy(F.col("a").alias("first")).agg(F.max(F.struct("size", F.col("b").alias("group"))).alias("larger"))
    chosen = F.greatest(F.struct("size", F.col("first").alias("group")), F.coalesce("larger", F.struct("size", F.col("first").alias("group"))))
    chosen = bases.join(larger, "first", "left").select("first", "size", chosen["group"].alias("group"))
    groups = cut(chosen.join(bases.select(F.col("first").alias("group"), "spots", F.col("size").alias("most")), "group"))
    if groups.isEmpty():
        return ordered.withColumn("group", F.lit(None).cast("bigint"))
    total = keyed.count()
    placed = join_hot(keyed.where("first IS NOT NULL"), groups, ["first"], "size", total)
    has = F.transform("shared", lambda s: s["spot"])
    lack = F.array_except("spots", has)
    more = lambda frequent: F.transform(F.filter("shared", lambda s: ((s["count"] > RARE) == frequent) & ~F.array_contains("spots", s["spot"])), lambda s: s["spot"])
    edits = placed.select("set", "group", "most", F.size(lack).alias("lack"), F.size("spots").alias("base"), F.array_sort(F.concat(lack, more(True))).alias("edits"), more(False).alias("extra"))
    few = (F.size("edits") <= MOST_EDITS) & (F.pow(F.lit(2.0), F.size("edits")) <= F.col("most"))
    return cut(ordered.join(edits.where(few).drop("most"), "set", "left"))


def _counts_inside(grouped: DataFrame, threshold: float) -> DataFrame:
    """``set`` and ``n_links``, how many others of its own group a set is alike to, without making the pairs.

    Sets of a group share the ``base`` but for what each of them lacks, so how many spots two of them share follows from
    their sizes and from how many edits and extra spots they have in common. They are alike from some number of common edits on.
    The sets with at least so many are counted by inclusion and exclusion from how many sets have each subset of a
    set's edits; these counts grow with the sets, not with the pairs. A subset is made only if its size is one that can
    decide about a pair: the empty one, and those from the least number of common edits that some set of the group
    asks for to the most that the two can have. Only sets with a common extra spot are looked at as pairs, at most
    ``RARE`` for each: those alike by that alone are added.
    """
    members = grouped.where("group IS NOT NULL").select("set", "group", "n", "lack", "base", "edits", "extra")

    def needed(n: Column, lack: Column) -> Column:
        return F.ceil(_least(F.col("n") + n, threshold)).cast("int") - F.col("base") + F.col("lack") + lack

    kind = ["group", "edits", "n", "lack", "base"]
    kinds = cut(members.groupBy(*kind).agg(F.count("*").alias("many")).withColumn("kind", F.monotonically_increasing_id()))
    none = F.array(F.struct(F.lit(0).cast("bigint").alias("hash"), F.lit(0).alias("size")))
    subsets = F.aggregate("edits", none, lambda all, edit: F.concat(all, F.transform(all, lambda s: F.struct(s["hash"].bitwiseXOR(F.xxhash64(edit)).alias("hash"), (s["size"] + 1).alias("size")))))
    adds = F.size("edits") - F.col("lack")

    def common_at_most(other: Column) -> Column:
        return F.least(F.col("lack"), other["lack"]) + F.least(adds, other["adds"])

    def common_at_least(other: Column) -> Column:
        return F.greatest(needed(other["least"], other["lack"]), F.lit(1))

    others = kinds.groupBy("group", "lack", adds.alias("adds")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("rows"))
    others = others.groupBy("group").agg(F.sum("rows").alias("rows"), F.collect_list(F.struct("lack", "adds", "least", "most")).alias("others"))
    open_ones = F.filter("others", lambda o: (needed(o["most"], o["lack"]) > 0) & (common_at_least(o) <= common_at_most(o)))
    ranged = join_hot(kinds, cut(others), ["group"], "rows", kinds.count()).withColumn("others", open_ones)
    ranged = ranged.withColumns({"low": F.array_min(F.transform("others", common_at_least)), "high": F.array_max(F.transform("others", common_at_most))})
    deciding = F.when(F.col("low").isNull(), none).otherwise(F.filter(subsets, lambda s: (s["size"] == 0) | s["size"].between(F.col("low"), F.col("high"))))
    parts = ranged.select("kind", "group", "n", "lack", "base", "many", F.explode(deciding).alias("part"))
    parts = cut(parts.select("kind", "group", "n", "lack", "base", "many", "part.hash", "part.size"))
    classes = parts.groupBy("group", "hash", "size", "n", "lack").agg(F.sum("many").alias("many"), F.count("*").alias("rows"))
    classes = classes.groupBy("group", "hash", "size").agg(F.sum("rows").alias("rows"), F.collect_list(F.struct("n", "lack", "many")).alias("classes"))
    signs = F.lit([(-1) ** (size - k) * math.comb(size - 1, k - 1) if 0 < k <= size else 0 for size in range(MOST_EDITS + 1) for k in range(MOST_EDITS + 1)])

    def share(other: Column) -> Column:
        def sign(k: Column) -> Column:
            inside = F.get(signs, F.col("size") * (MOST_EDITS + 1) + k)
            return F.when(k <= 0, (F.col("size") == 0).cast("int")).when(k > F.col("size"), 0).otherwise(inside)

        return let(needed(other["n"], other["lack"]), sign) * other["many"]

    shares = join_hot(parts.drop("many"), cut(classes), ["group", "hash", "size"], "rows", parts.count())
    shares = shares.select("kind", F.aggregate("classes", F.lit(0).cast("bigint"), lambda total, other: total + share(other)).alias("share"))
    itself = (F.size("edits") >= needed(F.col("n"), F.col("lack"))).cast("int")
    found = cut(kinds.join(shares.groupBy("kind").agg(F.sum("share").alias("share")), "kind").select(*kind, "many", (F.col("share") - itself).alias("n_links")))
    by_edits = join_hot(members.select("set", *kind), found, kind, "many", members.count()).select("set", "n_links")

    one = members.select("group", F.explode("extra").alias("spot"), "set", "n", "lack", "base", "edits", "extra")
    two = one.select("group", "spot", *(F.col(c).alias(f"{c}_") for c in ("set", "n", "lack", "edits", "extra")))
    common, both = F.size(F.array_intersect("edits", "edits_")), F.array_intersect("extra", "extra_")
    k = needed(F.col("n_"), F.col("lack_"))
    by_extra = (F.col("set") < F.col("set_")) & (k >= 1) & (common < k) & (common + F.size(both) >= k) & (F.col("spot") == F.array_min(both))
    added = one.join(two, ["group", "spot"]).where(by_extra).select(F.explode(F.array("set", "set_")).alias("set"), F.lit(1).cast("bigint").alias("n_links"))
    return by_edits.unionByName(added)


def _link_counts(sets: DataFrame, threshold: float) -> DataFrame:
    """``set`` and ``n_links`` of each set that is alike to others."""
    grouped = _grouped(_ordered(_possible(sets, threshold), threshold), threshold)
    ends = _links(grouped, threshold).select(F.explode(F.array("a", "b")).alias("set"), F.lit(1).cast("bigint").alias("n_links"))
    if "edits" in grouped.columns:
        ends = ends.unionByName(_counts_inside(grouped, threshold))
    return ends.groupBy("set").agg(F.sum("n_links").alias("n_links")).where("n_links > 0")


def similar_sets(prints: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """All pairs of different signature sets that are alike, and which rows have which set.

    ``prints`` comes from ``fingerprints``. Returns (pairs, members): pairs have ``left`` < ``right``
    (fingerprints, one for each class of equal sets) and ``likeness`` >= ``threshold``; members have
    ``doc_id`` and ``fingerprint``. Equal sets are one class and never form pairs. Spots are told
    apart by 64 bits of a hash. An empty table gives empty ones.
    """
    sets = _sets(prints)
    names = sets.select("set", "fingerprint")
    named = _links(_ordered(_possible(sets, threshold), threshold), threshold).join(names.toDF("a", "left"), "a").join(names.toDF("b", "right"), "b")
    return named.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "likeness"), prints.select("doc_id", "fingerprint")


def with_links(report: DataFrame, prints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``report`` with ``n_links``: to how many other classes of equal sets the row's own class is alike.

    ``report`` has ``doc_id``, ``edited_sha256`` and ``fingerprint``, as from ``edit_report``, and
    ``prints`` comes from ``fingerprints`` of the same documents; a fingerprint that ``prints`` lacks
    has no links. Only counts of the links come out, however large a group of near copies is, and a
    fingerprint that very many rows have is joined apart. An empty table gives an empty one.
    """
    sets = _sets(prints)
    links = cut(_link_counts(sets, threshold).join(sets.select("set", "fingerprint", "n_rows"), "set").drop("set"))
    total = sets.agg(F.sum("n_rows")).first()[0] or 0
    hot = links.where(F.col("n_rows") * HOT > total).select("fingerprint", F.col("n_links").alias("hot_links"))
    spread = F.concat(F.lit("#"), "edited_sha256", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    marked = report.join(F.broadcast(hot), "fingerprint", "left").withColumn("key", F.when(F.col("hot_links").isNull(), F.col("fingerprint")).otherwise(spread))
    found = marked.join(links.select(F.col("fingerprint").alias("key"), "n_links"), "key", "left")
    return found.select(*report.columns, F.coalesce("hot_links", "n_links", F.lit(0).cast("bigint")).alias("n_links"))


def with_next(docs: DataFrame, columns: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with ``columns`` and with ``next``, those of the row after it by ascending id; after the last comes the first.

    Rows are dealt into ranges of (id, hash of the text) that start at values of a sample, so rows
    without an id or with the same one are spread too; ranges are counted by the size of the texts.
    The first row of a range is also given to the range before, so no range needs to see another.
    ``columns`` are computed behind the only shuffle. Null ids come first; rows of one id follow each
    other by the hash of the text. Ids may be of any orderable type that JSON can write.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    mark, place, copy = (free_name([*docs.columns, *columns], name) for name in ("mark", "place", "copy"))
    keyed = docs.withColumn(mark, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")))
    least = F.to_json(F.min(mark), {"ignoreNullFields": "false"}).alias("least")
    row = keyed.agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col) + 64).alias("size"), least).first()
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(8, partitions, min(MOST_RANGES, (row["size"] or 0) // RANGE_BYTES))
    sampled = F.pmod(F.xxhash64(f"{mark}.id", f"{mark}.h"), F.lit(1_000_003)) <= 1_000_003 * min(1.0, 10 * ranges / max(1, row["n"]))
    sample = [r[0] for r in keyed.where(sampled).select(mark).distinct().orderBy(mark).select(F.to_json(mark, {"ignoreNullFields": "false"})).collect()]
    starts = sorted({len(sample) * k // ranges for k in range(1, ranges)} - {0}) if sample else []
    starts = [json.loads(x) for x in dict.fromkeys([row["least"] or "{}", *(sample[k] for k in starts)])]
    groups = [starts[k : k + GROUP] for k in range(0, len(starts), GROUP)]
    kind = f"array<struct<id:{id_type},h:bigint>>"
    firsts, all_starts = F.from_json(F.lit(json.dumps([g[0] for g in groups])), kind), F.from_json(F.lit(json.dumps(groups)), f"array<{kind}>")
    upto = lambda values: F.filter(values, lambda x: x <= F.col(mark))

    def dealt(group: Column) -> Column:
        def inside(found: Column) -> Column:
            own = group * GROUP + F.size(found) - 1
            first = F.get(found, F.size(found) - 1).eqNullSafe(F.col(mark))
            before = F.when(first, F.when(own > 0, own - 1).otherwise(len(starts) - 1))
            return F.array_compact(F.array(F.struct(own.alias("place"), F.lit(0).alias("copy")), F.when(before.isNotNull(), F.struct(before.alias("place"), F.lit(1).alias("copy")))))

        return let(upto(F.get(all_starts, group)), inside)

    spread = keyed.withColumn(copy, F.explode(let(F.size(upto(firsts)) - 1, dealt)))
    spread = spread.withColumns({place: F.col(f"{copy}.place"), copy: F.col(f"{copy}.copy")}).repartition(ranges, place)
    window = Window.partitionBy(place).orderBy(copy, mark, text_col)
    followed = spread.withColumns(columns).withColumn("next", F.lead(F.struct(*columns)).over(window))
    return followed.where(F.col(copy) == 0).drop(mark, place, copy)


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of whole texts and of edited texts, and how alike they are.

    The edited text has its last half (rounded down, in code points) replaced by as much of the next
    document's start. Returns a row for each row of ``docs``: ``doc_id``, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``. A null
    text counts as empty; see ``with_next`` for ties and null ids; an empty table gives an empty
    one; other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    chained = with_next(base, {"words": F.col("text"), "spots": signatures(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    text = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.words"), F.lit(1), half))
    edited = chained.select("doc_id", n.cast("bigint").alias("n_chars"), "spots", F.col("next.spots").alias("next_spots"), text.alias("edited"))
    found = edited.withColumn("edited_spots", signatures(F.col("edited")))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("spots")).alias("fingerprint"), fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def spots_sql(text: str) -> str:
    """The signature set in DuckDB SQL: each word that is none of the anchors, or is the last, after an anchor, with the next such word."""
    anchors = "[" + ", ".join(f"'{a}'" for a in sorted(set(ANCHORS))) + "]"
    words = f"string_split(trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')), ' ')"
    places = f"list_filter(range(1, len(w) + 1), lambda k: k = len(w) OR NOT list_contains({anchors}, w[k]))"
    starts = "list_filter(range(1, len(c)), lambda i: c[i] > 1 AND (i = 1 OR c[i - 1] < c[i] - 1))"
    spots = f"list_sort(list_distinct(list_transform({starts}, lambda i: w[c[i] - 1] || '~' || w[c[i]] || '~' || w[c[i + 1]])))"
    return f"""(SELECT CASE WHEN len(s) > 0 THEN s ELSE ['=' || sha256({text})] END
      FROM (SELECT {spots} AS s FROM (SELECT w, {places} AS c FROM (SELECT {words} AS w))))"""


#: The report with links in DuckDB SQL.
REPORT_SQL = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS next FROM documents
), edits AS (
  SELECT doc_id, text, next, length(text) AS n_chars, left(text, (length(text) - length(text) // 2)::BIGINT) || left(next, (length(text) // 2)::BIGINT) AS edited FROM base
), sets AS (
  SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {spots_sql("text")} AS a, {spots_sql("edited")} AS b, {spots_sql("next")} AS c FROM edits
), spots AS (
  SELECT f, len(a) AS n, unnest(a) AS spot FROM (SELECT DISTINCT sha256(array_to_string(a, ',')) AS f, a FROM sets)
), alike AS (
  SELECT x.f FROM spots x JOIN spots y ON x.spot = y.spot AND x.f <> y.f GROUP BY x.f, y.f, x.n, y.n HAVING count(*) / (x.n + y.n - count(*)) >= {THRESHOLD} - 1e-12
), links AS (
  SELECT f, count(*) AS n_links FROM alike GROUP BY f
)
SELECT doc_id, n_chars, edited_sha256, sha256(array_to_string(a, ',')) AS fingerprint, sha256(array_to_string(b, ',')) AS edited_fingerprint,
       len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS near_edited, len(list_intersect(a, c)) / (len(a) + len(c) - len(list_intersect(a, c))) AS near_next,
       coalesce(n_links, 0) AS n_links
FROM sets LEFT JOIN links ON f = sha256(array_to_string(a, ','))
"""
