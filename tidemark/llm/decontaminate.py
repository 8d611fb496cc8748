"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all benchmark items, normalised, become the patterns of one automaton whose letters
are the benchmark's words. Each document is normalised in the same way and scanned once; hits are
counted in words and mapped back to code-point offsets of the original text.

The automaton holds the benchmark, not the corpus, and its size is checked: it has at most as many
nodes as the items have words, times the window. A benchmark of more than ``max_nodes`` is dealt
into blocks by a hash, long items in pieces. A worker then holds the automaton of one block at a
time, each block scans the documents by itself, and only their hits are brought together.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from itertools import batched

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, free_name, slices, text_or_empty

#: Fixed: words are runs of digits, letters a-z and anything beyond ASCII.
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")
ITEM_WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: By byte of UTF-8: A-Z to lower case, what is in no word to a space.
NORMAL = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
WINDOW = 10
#: Nodes of an automaton; one takes about 90 bytes.
MAX_NODES = 3_000_000
#: Windows in a piece of an item; bytes of text that are taken apart at once.
PIECE, SEGMENT = 1000, 1 << 18
#: Blocks whose hits are gathered in one job.
TOGETHER = 16
RANGES = "array<struct<first:bigint,last:bigint>>"
SPANS = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"


class Windows:
    """The automaton of (item id, words) rows."""

    def __init__(self, rows: Iterable[tuple[str, list[str]]], size: int):
        self.size, self.number = size, {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, words in rows:
            codes = [self.number.setdefault(w.encode(), len(self.number) + 1) for w in words]
            for k in range(max(1, len(codes) - size + 1) if codes else 0):
                owners.setdefault(tuple(codes[k : k + size]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in owners.items():
            self.automaton.add_word(window, (len(window), tuple(items)))
        if owners:
            self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, set[tuple[int, int]], set[str]]:
        """Number of words, hit word ranges (last exclusive) and the items found.

        Long texts are taken apart piece by piece; a piece starts with the last words before it.
        """
        line = text.encode().translate(NORMAL)
        total, ranges, items, kept, at = 0, set(), set(), (), 0
        get, empty = self.number.get, not self.number
        while at < len(line):
            end = line.find(b" ", at + SEGMENT)
            end = len(line) if end < 0 else end
            words = (line if end - at == len(line) else line[at:end]).split()
            at = end
            if not empty:
                codes = (*kept, *[get(w, 0) for w in words])
                for last, (n, found) in self.automaton.iter(codes):
                    first = total - len(kept) + last - n + 1
                    ranges.add((first, first + n))
                    items.update(found)
                kept = codes[1 - self.size :] if self.size > 1 else ()
            total += len(words)
        return total, ranges, items


@functools.lru_cache(1)
def automaton_of(rows: Broadcast, size: int) -> Windows:
    """One in each worker, until it needs another."""
    return Windows(rows.value, size)


def merged(ranges: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Word ranges (last exclusive) as disjoint ones in order."""
    out: list[list[int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def placed(text: str, ranges: Iterable[tuple[int, int]]) -> list[dict[str, int]]:
    """Disjoint runs of words with their code points in the original text."""
    runs = merged(ranges)
    wanted = {k for first, last in runs for k in (first, last - 1)}
    at = {k: m.span() for k, m in enumerate(WORD.finditer(text)) if k in wanted} if runs else {}
    return [{"first": a, "last": b, "start": at[a][0], "end": at[b - 1][1]} for a, b in runs]


def item_blocks(items: DataFrame, item_col: str, text_col: str, size: int, max_nodes: int) -> tuple[int, Iterator[Broadcast]]:
    """How many blocks the items make, and one after the other as broadcast (item id, words) rows.

    Pieces of an item share ``size`` - 1 words, so that each of its windows is in one of them.
    """
    words = F.regexp_extract_all(F.translate(text_or_empty(text_col), UPPER, LOWER), F.lit(ITEM_WORD), F.lit(1))
    whole = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)), F.lit(PIECE))
    pieces = whole.select("item", "words", F.explode(starts).alias("start")).select("item", F.slice("words", F.col("start") + 1, F.lit(PIECE + size - 1)).alias("words"))
    blocks = 1 + (pieces.agg(F.sum(F.size("words"))).first()[0] or 0) * size // max_nodes
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    if blocks > 1:
        dealt = cut(dealt)

    def sent() -> Iterator[Broadcast]:
        for n in range(blocks):  # each is bounded by max_nodes
            rows = [tuple(r) for r in dealt.where(F.col("block") == n).select("item", "words").collect()]
            yield items.sparkSession.sparkContext.broadcast(rows)

    return blocks, sent()


def _block_hits(rows: DataFrame, sent: Broadcast, size: int) -> DataFrame:
    """``row``, ``ranges`` and ``item_ids`` of the rows (``row``, ``text``) with hits in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = automaton_of(sent, size)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in slices(batches):
            found = [(k, *windows.scan(t.as_py())[1:]) for k, t in enumerate(batch.column(1))]
            found = [(k, merged(ranges), sorted(items)) for k, ranges, items in found if ranges]
            ranges = pa.array([[{"first": a, "last": b} for a, b in r] for _, r, _ in found], kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([k for k, _, _ in found], pa.int64())), ranges, pa.array([i for _, _, i in found], pa.list_(pa.string()))], ["row", "ranges", "item_ids"]
            )

    return rows.mapInArrow(run, f"row bigint, ranges {RANGES}, item_ids array<string>")


def _all_hits(rows: DataFrame, blocks: Iterator[Broadcast], size: int) -> DataFrame:
    """The hits of all blocks, a row for each row and block; each few blocks are one job."""
    gathered = None
    for group in batched(blocks, TOGETHER):
        parts = [_block_hits(rows, sent, size) for sent in group]
        hits = cut(functools.reduce(DataFrame.union, parts))
        gathered = hits if gathered is None else gathered.union(hits)
    return gathered


def _with_spans(rows: DataFrame, scanned, columns: list[str]) -> DataFrame:
    """``doc_id``, ``n_words``, ``spans`` and ``item_ids``; ``scanned`` makes a function of (text, *columns) in the worker."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanned()
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")]))
        for batch in slices(batches):
            found = []
            for row in zip(*(batch.column(c) for c in ("text", *columns))):
                text, *rest = (v.as_py() for v in row)
                n, ranges, items = scan(text, *rest)
                found.append((n, placed(text, ranges), sorted(items)))
            made = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), kind, pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n_words", "spans", "item_ids"])

    return rows.mapInArrow(run, f"doc_id {id_type}, n_words bigint, spans {SPANS}, item_ids array<string>")


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, max_nodes: int = MAX_NODES
) -> DataFrame:
    """Where whole texts hold windows of benchmark items.

    Returns a row for each row of ``docs``: ``doc_id``, ``n_words``, ``spans`` (disjoint hit runs:
    words ``first`` to ``last`` and code points ``start`` to ``end``, ends exclusive) and
    ``item_ids`` (items with occurring windows, as strings, sorted). A null text has no words, a
    null item id counts as ``null``, an item without words is never found, repeated rows stay, an
    empty table of either kind gives no hits, other columns are not read.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    blocks, sent = item_blocks(items, item_col, item_text_col, size, max_nodes)
    if blocks == 1:
        rows = next(sent)
        return _with_spans(chosen, lambda: automaton_of(rows, size).scan, [])
    keyed = cut(chosen.withColumn("row", F.monotonically_increasing_id()))
    hits = _all_hits(keyed.select("row", "text"), sent, size)
    joined = hits.groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))
    counted = lambda text, ranges, items: (len(text.encode().translate(NORMAL).split()), {(r["first"], r["last"]) for r in ranges or ()}, items or ())
    return _with_spans(keyed.join(joined, "row", "left"), lambda: counted, ["ranges", "item_ids"])


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])


def contamination_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Counts and a digest in place of the spans and item ids of ``find_contamination``."""
    found = find_contamination(docs, items, **options)
    return found.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (hit_words() > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, max_nodes: int = MAX_NODES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of an item; see ``find_contamination``.

    Each row is judged by itself, so null and repeated ids do no harm; an empty table gives an empty one.
    """
    blocks, sent = item_blocks(items, item_col, item_text_col, size, max_nodes)
    if blocks > 1:
        key = free_name(docs.columns, "row")
        keyed = cut(docs.withColumn(key, F.monotonically_increasing_id()))
        hits = _all_hits(keyed.select(F.col(key).alias("row"), text_or_empty(text_col).alias("text")), sent, size)
        return keyed.join(hits.select(F.col("row").alias(key)), key, "left_anti").select(*docs.columns)
    rows, place = next(sent), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = automaton_of(rows, size)
        for batch in slices(batches):
            yield batch.filter(pa.array([not windows.scan(t.as_py() or "")[1] for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: The report in DuckDB SQL.
REPORT_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM benchmark
), starts AS (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS gram FROM starts
), sizes AS (SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n
), hits AS (
  SELECT p.doc_id, p.i, p.n, x.item_id
  FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM places) p JOIN windows x ON p.n = x.n AND p.gram = x.gram
), hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items i ON d.doc_id = i.doc_id
"""
