"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint of 64 bits is embedded as the bit counts of its 32 two-bit segments. Two
fingerprints differ in at least as many bits as their embeddings lie apart in Manhattan distance,
so a range join on the embedding loses no pair. The segments are dealt to ``BANDS`` bands; at a
Manhattan distance of 3 or less, at least ``BANDS - 3`` bands agree, so the join meets each such
pair in a grid cell of some ``BANDS - 3`` bands. What meets there is held against the Manhattan
bound over all segments and then verified bit by bit.

Only distinct fingerprints take part, so exact copies never form pairs. Cells with one member are
left out by their counts before members travel. Members of a cell are linked into a forest, not
listed as pairs. A cell with more than ``dense`` members is never brought together: its members
are linked through the fingerprints around them (see ``_dense_links``), which is linear in their
number and exact too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, join_hot, slices, text_or_empty
from .components import connected_components

SEED = 42
SHINGLE = 3
DISTANCE = 3
BANDS = 6
LOW_BITS = 0x5555555555555555
#: Larger cells are linked by way of the fingerprints around their members.
DENSE = 20_000
LOWER = bytes(range(256)).lower()


def fingerprint(text: str) -> int:
    """The unsigned fingerprint of a whole text."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def embed(prints: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, each in two bits."""
    low, high = prints & np.uint64(LOW_BITS), (prints >> np.uint64(1)) & np.uint64(LOW_BITS)
    return (low ^ high) | ((low & high) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distance of embeddings: a segment's two bits of ``a ^ b`` are 01, 10, 11 at 1, 2, 1."""
    both = a ^ b
    low, high = both & np.uint64(LOW_BITS), (both >> np.uint64(1)) & np.uint64(LOW_BITS)
    return np.bitwise_count(low | high) + np.bitwise_count(high & ~low)


def band_masks() -> list[int]:
    """For each choice of ``BANDS - DISTANCE`` bands, the bits of their segments, as signed numbers."""
    ends = [round(32 * k / BANDS) for k in range(BANDS + 1)]
    bands = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(ends, ends[1:])]
    masks = [sum(chosen) for chosen in combinations(bands, BANDS - DISTANCE)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def cell_links(cell: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is near within each run of equal ``cell``: a forest, as index pairs."""
    n, points = len(prints), embed(prints)
    parent, root = np.arange(n), np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, step = np.arange(n), 0
    while True:
        step += 1
        left = left[left + step < n]
        left = left[cell[left + step] == cell[left]]
        if not len(left):
            break
        near = left[manhattan(points[left], points[left + step]) <= DISTANCE]
        near = near[np.bitwise_count(prints[near] ^ prints[near + step]) <= DISTANCE]
        near = near[root[near] != root[near + step]]
        if len(near):
            for i in near:
                a, b = find(i), find(i + step)
                parent[max(a, b)] = min(a, b)
            root = parent
            while (root != parent[root]).any():
                root = parent[root]
            parent = root.copy()
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def _link_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; only the last, unfinished cell of a batch is held over."""
    held = None

    def made(rows: np.ndarray) -> pa.RecordBatch:
        new = np.any(rows[1:, :2] != rows[:-1, :2], axis=1)
        prints = rows[:, 2].view(np.uint64)
        a, b = cell_links(np.concatenate([[0], np.cumsum(new)]), prints)
        return pa.RecordBatch.from_arrays([pa.array(rows[a, 2]), pa.array(rows[b, 2])], ["a", "b"])

    for batch in batches:
        rows = np.ascontiguousarray(np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]))
        if held is not None:
            rows = np.ascontiguousarray(np.concatenate([held, rows]))
        if not len(rows):
            continue
        starts = np.flatnonzero(np.any(rows[:, :2] != rows[-1, :2], axis=1))
        cutoff = starts[-1] + 1 if len(starts) else 0
        if cutoff:
            yield made(np.ascontiguousarray(rows[:cutoff]))
        held = rows[cutoff:]
    if held is not None and len(held):
        yield made(np.ascontiguousarray(held))


def _around(radius: int):
    """A function for mapInArrow: each fingerprint with all fingerprints at most ``radius`` bits off."""
    masks = np.array([sum(1 << bit for bit in bits) for r in range(radius + 1) for bits in combinations(range(64), r)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(prints), 64):
                part = prints[k : k + 64]
                spread = (part[:, None] ^ masks[None, :]).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(spread.view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))], ["place", "fp"])

    return run


def _dense_links(prints: DataFrame) -> DataFrame:
    """Exact links among many fingerprints that crowd together, without pairs.

    Two are at most 3 bits apart just if some place is at most 1 bit from one and 2 from the other.
    So each place that has somebody within 1 bit links the least such with all within 2 bits.
    """
    near = prints.mapInArrow(_around(1), "place bigint, fp bigint").groupBy("place").agg(F.min("fp").alias("b"))
    wide = prints.mapInArrow(_around(2), "place bigint, fp bigint")
    return wide.join(near, "place").select(F.col("fp").alias("a"), "b").where("a != b").distinct()


def near_links(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links that connect all fingerprints (distinct, column ``fp``) at most 3 bits apart."""
    low, high = F.col("fp").bitwiseAND(LOW_BITS), F.shiftrightunsigned("fp", 1).bitwiseAND(LOW_BITS)
    points = prints.select("fp", low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1)).alias("point"))
    cells = F.array(*[F.struct(F.lit(k).alias("bands"), F.col("point").bitwiseAND(F.lit(mask)).alias("cell")) for k, mask in enumerate(band_masks())])
    keyed = points.select("fp", F.explode(cells).alias("c")).select("c.bands", "c.cell", "fp")
    shared = cut(keyed.groupBy("bands", "cell").agg(F.count("*").alias("n")).where("n > 1"))
    met = keyed.join(shared, ["bands", "cell"])
    usual = met.where(F.col("n") <= dense).select("bands", "cell", "fp").repartition("bands", "cell").sortWithinPartitions("bands", "cell", "fp")
    links = usual.mapInArrow(_link_cells, "a bigint, b bigint")
    if not shared.where(F.col("n") > dense).isEmpty():
        links = links.union(_dense_links(met.where(F.col("n") > dense).select("fp").distinct()))
    return links


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed number) and ``fingerprint`` (16 hex digits)."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    id_type = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [fingerprint(text.as_py()) for text in batch.column(1)]
            signed = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed, pa.array([f"{p:016x}" for p in prints], pa.string())], ["doc_id", "fp", "fingerprint"])

    return chosen.mapInArrow(run, f"doc_id {id_type}, fp bigint, fingerprint string")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """SimHash fingerprints of whole texts and the groups that they form.

    Returns a row for each row of ``docs``: ``doc_id``, ``fingerprint``, ``component_id``, the least
    id among the documents reachable by links of 3 or fewer differing bits. A null or empty text
    has fingerprint zero and is linked like any other. Repeated rows stay, a null id is never a
    component's id unless its component has no other, an empty table gives an empty one, other
    columns are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = connected_components(near_links(distinct.select("fp"), dense), "a", "b").withColumnRenamed("node", "fp")
    members = cut(distinct.join(roots, "fp", "left"))
    joined = members.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("size"))
    linked = join_hot(members.where(F.col("root").isNotNull()), joined, ["root"], "size", members.count())
    alone = members.where(F.col("root").isNull()).select("fp", "n", F.col("first").alias("component_id"))
    groups = cut(linked.select("fp", "n", F.col("least").alias("component_id")).unionByName(alone))
    return join_hot(prints, groups, ["fp"], "n", prints.count()).select("doc_id", "fingerprint", "component_id")


def _mod(x: str) -> str:
    return f"(({x}) % 18446744073709551616::UHUGEINT)"


def _turned(x: str, by: int) -> str:
    """The 64 bits of ``x`` turned left."""
    return f"({_mod(f'{x} * {1 << by}::UHUGEINT')} + ({x}) // {1 << (64 - by)}::UHUGEINT)"


def xxh64_sql(hexadecimal: str, size: str) -> str:
    """XXH64 in DuckDB SQL of bytes given as upper-case hex digits, and of their number; an unsigned 128-bit value.

    State and lanes go through ``list_reduce``, so each step names its operands once.
    """
    #: Fixed: the five primes of the hash.
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))

    def lane(start: str, width: int) -> str:
        bytes_ = " || ".join(f"substr({hexadecimal}, ({start}) * 2 + {2 * k + 1}, 2)" for k in reversed(range(width)))
        return f"('0x' || {bytes_})::UBIGINT::UHUGEINT"

    def fold(start: str, steps: str, x: str, body: str) -> str:
        return f"list_reduce(list_prepend({start}, {steps}), lambda h, {x}: {body})"

    def then(value: str, name: str, body: str) -> str:
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    mixed = lambda x: _mod(then(_mod(f"({x}) * {p2}"), "y", _turned("y", 31)) + f" * {p1}")
    starts = [(SEED + 11400714785074694791 + 14029467366897019727) % 2**64, SEED + 14029467366897019727, SEED, (SEED - 11400714785074694791) % 2**64]
    accumulators = []
    for k, start in enumerate(starts):
        lanes = f"list_transform(range({size} // 32), lambda j: {lane(f'j * 32 + {8 * k}', 8)})"
        turned = then(_mod(f"h + {_mod(f'x * {p2}')}"), "z", _turned("z", 31))
        accumulators.append(fold(f"{start % 2**64}::UHUGEINT", lanes, "x", _mod(f"{turned} * {p1}")))
    both = then(f"[{', '.join(accumulators)}]", "v", fold(_mod(" + ".join(_turned(f"v[{k + 1}]", r) for k, r in enumerate((1, 7, 12, 18)))), "v", "x", _mod(f"{_mod(f'xor(h, {mixed("x")}) * {p1}')} + {p4}")))
    first = _mod(f"CASE WHEN {size} >= 32 THEN {both} ELSE {_mod(f'{SEED}::UHUGEINT + {p5}')} END + ({size})::UHUGEINT")
    eights = f"list_transform(range(({size} % 32) // 8), lambda j: {lane(f'{size} // 32 * 32 + j * 8', 8)})"
    after8 = fold(first, eights, "x", _mod(then(f"xor(h, {mixed('x')})", "z", _turned("z", 27)) + f" * {p1} + {p4}"))
    fours = f"list_transform(range(({size} % 8) // 4), lambda j: {lane(f'{size} // 8 * 8', 4)})"
    after4 = fold(after8, fours, "x", _mod(f"{_mod(then('xor(h, ' + _mod(f'x * {p1}') + ')', 'z', _turned('z', 23)) + f' * {p2}')} + {p3}"))
    ones = f"list_transform(range({size} % 4), lambda j: {lane(f'{size} // 4 * 4 + j', 1)})"
    after1 = fold(after4, ones, "x", _mod(then("xor(h, " + _mod(f"x * {p5}") + ")", "z", _turned("z", 11)) + f" * {p1}"))
    for shift, prime in ((33, p2), (29, p3), (32, None)):
        after1 = then(after1, "f", f"xor(f, f // {1 << shift}::UHUGEINT)")
        after1 = _mod(f"{after1} * {prime}") if prime else after1
    return after1


#: Fingerprints and components in DuckDB SQL; all distinct fingerprints against all, so for small tables.
REPORT_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT r, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), hashes AS (
  SELECT s, ({xxh64_sql("x", "n")})::UBIGINT AS h FROM (SELECT s, hex(s) AS x, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM shingles))
), bits AS (
  SELECT r, count(*) AS n, {", ".join(f"count(*) FILTER ((h >> {b}) & 1 = 1) AS b{b}" for b in range(64))} FROM shingles JOIN hashes USING (s) GROUP BY r
), prints AS (
  SELECT doc_id, coalesce({" + ".join(f"(2 * b{b} > n)::UHUGEINT * {1 << b}::UHUGEINT" for b in range(64))}, 0)::UBIGINT AS fp FROM words LEFT JOIN bits USING (r)
), classes AS (SELECT fp, min(doc_id) AS least FROM prints GROUP BY fp
), links AS (SELECT a.fp AS a, b.fp AS b FROM classes a JOIN classes b ON bit_count(xor(a.fp, b.fp)) <= 3
), reached AS (SELECT fp AS a, fp AS b FROM classes UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), components AS (SELECT r.a AS fp, min(c.least) AS component_id FROM reached r JOIN classes c ON r.b = c.fp GROUP BY r.a)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component_id FROM prints JOIN components USING (fp)
"""
