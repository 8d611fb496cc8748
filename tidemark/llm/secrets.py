"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

Prose costs a byte-pair vocabulary one token for several characters, a random string nearly one
for every second character. So a long unbroken string with few characters for each token is taken
for a secret, unless it is a known kind of digest or identifier. Base spans always stay.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, text_or_empty

#: Fixed: the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
#: Strings that the test looks at. Shorter ones are too often words.
UNBROKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Digests (MD5, SHA-1, SHA-2 in hex), UUIDs, and strings without a letter (numbers, dates, rules) are no secrets.
KNOWN = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9+/_=-]+)", re.IGNORECASE | re.ASCII)
#: How byte-pair ranks of this family split a text.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fewer characters for each token than this count as random.
RATIO = 2.0


@functools.lru_cache(2)
def vocabulary(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def looks_random(string: str, encoding: tiktoken.Encoding, ratio: float = RATIO) -> bool:
    """No known digest or identifier, few characters a token."""
    return not KNOWN.fullmatch(string) and len(string) < ratio * len(encoding.encode_ordinary(string))


def find_spans(text: str, encoding: tiktoken.Encoding, ratio: float = RATIO) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    spans = []
    if "=" in text or ":" in text:
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    covered = runs(spans)
    at = 0
    for m in UNBROKEN.finditer(text):
        a, b = m.span()
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        if (at == len(covered) or covered[at][0] >= b) and looks_random(m[0], encoding, ratio):
            spans.append(("random", a, b))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def runs(spans: list[tuple[str, int, int]]) -> list[list[int]]:
    """What spans of any kind cover, as disjoint (start, end) in order."""
    out: list[list[int]] = []
    for start, end in sorted((a, b) for _, a, b in spans):
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each run of touching spans gives way to ``<secret>``."""
    out, at = [], 0
    for _, start, end in spans:
        if end <= at:
            continue
        if start > at or not out:
            out += [text[at:start], "<secret>"]
        at = end
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan_secrets(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO, keep_text: bool = False) -> DataFrame:
    """The secrets of each whole text.

    ``path`` names a tiktoken rank file that every executor can read. Returns a row for each row of
    ``docs``: ``doc_id``, ``spans`` and, with ``keep_text``, ``redacted``, the text with
    ``<secret>`` in their place. A null text counts as empty and has no spans (``redacted`` is then
    empty too), repeated rows and null ids stay, an empty table gives an empty one, other columns
    are not read.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    id_type = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(path)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            found, texts = [], []
            for text in batch.column(1):
                text = text.as_py()
                spans = find_spans(text, encoding, ratio)
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                if keep_text:
                    texts.append(redact(text, spans))
            columns = [batch.column(0), pa.array(found, kind), *[pa.array(texts, pa.string())] * keep_text]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans", *["redacted"] * keep_text])

    return chosen.mapInArrow(run, f"doc_id {id_type}, spans {SPANS}" + ", redacted string" * keep_text)


def secret_report(docs: DataFrame, path: str, **options) -> DataFrame:
    """Counts, a digest of the base spans and all spans as text."""
    found = scan_secrets(docs, path, **options)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def redact_column(docs: DataFrame, path: str, text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """``docs`` with its texts redacted in place; all other columns stay as they are.

    A null text becomes an empty one; repeated rows stay, an empty table gives an empty one.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(place).to_pylist()]
            clean = pa.array([redact(t, find_spans(t, encoding, ratio)) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([clean if k == place else batch.column(k) for k in range(batch.num_columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
