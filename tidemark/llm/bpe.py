"""Byte-level BPE by backtracking over Aho-Corasick matches, and decoding by an offset table.

A sequence of tokens is the BPE encoding of its bytes exactly if each neighbouring pair is: if the
merges, run over the pair's bytes alone, leave just that pair. So a piece of text is encoded from
left to right. At each place the longest vocabulary entry that starts there, found by Aho-Corasick,
is tried first; it stands if it is compatible with the token before it, or else gives way to the
longest entry that it starts with. If none stands, the place is marked dead and the last token is
taken back for its next shorter one. Each place is given up at most once, so the work is linear in
the length. Pair checks are kept in a table.

Spark spreads the texts over tasks. A worker holds one encoder and a bounded table of pieces.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import math
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Remembered, slices, text_or_empty

#: Fixed: how byte-level vocabularies of this family split a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs, words and other pieces that a worker remembers at once.
PAIRS, WORDS, REMEMBERED = 300_000, 300_000, 100_000


def byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabulary files write each byte.

    Printable Latin-1 bytes stand for themselves, the others follow from U+0100 on in byte order.
    """
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class BacktrackingEncoder:
    """Encoder and decoder for a byte-level BPE vocabulary file in JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec.get("normalizer") is not None or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE without a normalizer is needed")
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        #: The bytes of each entry, as Latin-1 text, so that one character is one byte.
        raw = lambda entry: "".join(chr(byte_of[c]) for c in entry)
        vocab = {raw(entry): i for entry, i in spec["model"]["vocab"].items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): n for n, (a, b) in enumerate(pairs)}
        self.vocab, self.entry = vocab, {i: t for t, i in vocab.items()}
        self.top = top = 1 + max([*self.entry, *added.values()])
        self.halves = {token: self.halves_of(token) for token in vocab}
        usual = {token: i for token, i in vocab.items() if self.halves[token]}  # others never come out of the merges
        self.matcher = ahocorasick.Automaton()
        #: By id: the length of an entry, and the longest entry that it starts with (-1: none).
        self.length, self.shorter = [0] * top, [-1] * top
        for token, i in usual.items():
            self.matcher.add_word(token, i)
            self.length[i] = len(token)
            self.shorter[i] = next((usual[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in usual), -1)
        self.matcher.make_automaton()
        self.pieces = regex.compile(PIECES)
        #: Whether each merge comes after those that make its two parts, as in a trained vocabulary.
        self.ordered = all(self.made_at(part) < n for pair, n in self.rank.items() if self.halves.get("".join(pair)) == pair for part in pair)
        self.edges: dict[tuple[str, int], list[tuple[str, float]]] = {}
        #: By left * top + right, if the merges leave such a pair as it is.
        self.pairs = Remembered(self._compatible, PAIRS)
        self.known = Remembered(self._piece, REMEMBERED)
        self.spaced = Remembered(self._spaced, WORDS)
        texts = [b""] * top
        for i, t in self.entry.items():
            texts[i] = t.encode("latin-1")
        for t, i in added.items():
            texts[i] = t.encode()
        #: All entries' bytes end to end, and where each starts.
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def merges(self, token: str) -> Iterator[list[str]]:
        """The parts before each merge and at the end. Only for short strings: entries and pairs of them."""
        parts = list(token)
        while True:
            yield parts
            ranks = [self.rank.get(pair, math.inf) for pair in zip(parts, parts[1:])]
            best = min(ranks, default=math.inf)
            if best == math.inf:
                return
            k = ranks.index(best)
            parts = [*parts[:k], parts[k] + parts[k + 1], *parts[k + 2 :]]

    def halves_of(self, token: str) -> tuple[str, ...]:
        """The two parts of the last merge to an entry, itself if it is one byte; empty if the merges don't lead to it."""
        *before, last = self.merges(token)
        return () if last != [token] else tuple(before[-1]) if before else (token,)

    def made_at(self, token: str) -> float:
        """The rank of the last merge to an entry; -1 for a single byte."""
        return self.rank[self.halves[token]] if len(token) > 1 else -1

    def edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The parts that stand at one end of an entry (side 0 or -1) while it is made, each with the rank of the merge that ends it."""
        found = self.edges.get((token, side))
        if found is None:
            found, part, until = [], token, math.inf
            while True:
                found.append((part, until))
                if len(part) == 1:
                    break
                until = self.made_at(part)
                part = self.halves[part][side]
            self.edges[token, side] = found
        return found

    def _compatible(self, pair: int) -> bool:
        """Whether no merge over the border comes up while its two sides stand there. Of equal merges the leftmost is first."""
        left, right = self.entry[pair // self.top], self.entry[pair % self.top]
        if not self.ordered:
            return list(self.merges(left + right))[-1] == [left, right]
        for a, a_until in self.edge(left, -1):
            for b, b_until in self.edge(right, 0):
                rank = self.rank.get((a, b))
                if rank is not None and rank < a_until and rank <= b_until:
                    return False
        return True

    def encode_piece(self, piece: str) -> list[int]:
        """``piece``: bytes as Latin-1 text."""
        size, longest, length, shorter, pairs, top = len(piece), self.matcher.iter_long, self.length, self.shorter, self.pairs, self.top
        dead, path, here = bytearray(size + 1), [], 0
        token = next(longest(piece))[1] if piece else -1
        while here < size:
            while token >= 0 and (dead[here + length[token]] or (path and not pairs[path[-1] * top + token])):
                token = shorter[token]
            if token >= 0:
                path.append(token)
                here += length[token]
                if here < size:
                    token = next(longest(piece, here))[1]
            else:
                if not path:
                    raise ValueError("the vocabulary lacks single bytes")
                dead[here] = 1
                token = path.pop()
                here -= length[token]
                token = shorter[token]
        return path

    def _piece(self, piece: str) -> bytes:
        return array("I", self.encode_piece(piece.encode().decode("latin-1"))).tobytes()

    def _run(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.pieces.findall(text)))

    def _spaced(self, word: str) -> bytes | None:
        """The ids of a space and a word; None where whitespace stands before the next space."""
        if not word or word[-1].isspace():
            return None
        pieces = self.pieces.findall(" " + word)
        return self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self.known.__getitem__, pieces))

    def _ordinary(self, text: str) -> bytes:
        """A piece goes on into a space from whitespace only, so where no space follows whitespace, each begins a piece."""
        first, *words = text.split(" ")
        found = list(map(self.spaced.__getitem__, words[:-1]))
        if not words or None in found or first[-1:].isspace():
            return self._run(text)
        return b"".join([self._run(first), *found, self._run(" " + words[-1])])

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text; strings of added tokens in it count as these tokens."""
        parts = self.split_added.split(text) if self.split_added else [text]
        return np.frombuffer(b"".join([self.added[part] if n % 2 else self._ordinary(part) for n, part in enumerate(parts)]), "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Gathers the entries' bytes by their offsets."""
        first = self.starts[ids]
        lengths = self.starts[ids + 1] - first
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        return self.blob[np.arange(ends[-1]) + np.repeat(first - (ends - lengths), lengths)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(2)
def encoder(path: str) -> BacktrackingEncoder:
    """One for each vocabulary and worker."""
    made = BacktrackingEncoder(path)
    gc.freeze()  # the tables live as long as the worker
    return made


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """Encodes and decodes each whole text.

    Returns a row for each row of ``docs``: the id, ``n_tokens``, ``ids_sha256`` (of the decimal
    ids joined by commas), ``decoded_sha256``, with ``keep_ids`` ``ids`` and with ``keep_text`` ``decoded``.
    A null text counts as empty and an empty text has no tokens. Null ids and repeated rows stay
    as they are, an empty table gives an empty one, other columns are not read.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    id_type = chosen.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        digits = [str(i) for i in range(len(codec.starts))]
        for batch in slices(batches):
            counts, id_hashes, text_hashes, all_ids, texts = [], [], [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                decoded = codec.decode(ids)
                counts.append(len(ids))
                id_hashes.append(hashlib.sha256(",".join([digits[i] for i in ids.tolist()]).encode()).hexdigest())
                text_hashes.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    all_ids.append(ids.astype(np.int32))
                if keep_text:
                    texts.append(decoded)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            if keep_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    return chosen.mapInArrow(run, schema)
