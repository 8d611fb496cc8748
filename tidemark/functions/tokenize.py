"""Byte-pair tokenizer by merge ranks, for small vocabularies given as data."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed: characters that stand alone, the mark of a word's start, and the special tokens.
PUNCTUATION = """.,!?;:"'()[]{}-/\\@#$%^&*+=<>|~`"""
START = "Ġ"
SPECIAL = ("[CLS]", "[SEP]", "[PAD]", "[UNK]")
SPACES = " \t\n\r"
ALONE = f"[{re.escape(SPACES + PUNCTUATION)}]"
SIMPLE = f"{ALONE}|[^{re.escape(SPACES + PUNCTUATION)}]+"
#: Words that a worker remembers, and the longest of them.
KNOWN, LONGEST = 50_000, 40


def words_simple(text: str) -> list[str]:
    """Spaces and punctuation marks one by one, and what stands between them."""
    return re.findall(SIMPLE, text)


def words_marked(text: str) -> list[str]:
    """Without spaces; a word that follows a space is marked, unless it is the first thing.

    A mark before punctuation is a word of its own.
    """
    out: list[str] = []
    for chunk in re.split(f"[{SPACES}]+", text):
        mark = START if out else ""
        for k, part in enumerate(re.findall(SIMPLE, chunk)):
            alone = part in PUNCTUATION
            if k or not mark:
                out.append(part)
            else:
                out += [mark, part] if alone else [mark + part]
    return out


def read_tokenizer(spark: SparkSession, vocab_path: str, merges_path: str) -> Tokenizer:
    """From a JSON object of piece and id, and a text of one merge a line; blank lines and lines from ``#`` on are passed over."""
    whole = lambda path: spark.read.text(path, wholetext=True).first()[0]
    lines = (line.split() for line in whole(merges_path).splitlines() if line.strip() and not line.startswith("#"))
    return Tokenizer(json.loads(whole(vocab_path)), [(a, b) for a, b in lines])


@dataclass
class Tokenizer:
    vocab: dict[str, int]
    merges: list[tuple[str, str]]
    rank: dict[tuple[str, str], int] = field(init=False)

    def __post_init__(self):
        self.rank = {pair: k for k, pair in enumerate(self.merges)}
        self.token = {i: t for t, i in self.vocab.items()}
        self.special = {name: self.vocab[name] for name in SPECIAL if name in self.vocab}
        self.marked = any(START in t for t in self.vocab)
        self.known: dict[str, list[int]] = {}

    def __len__(self) -> int:
        return len(self.vocab)

    def pieces(self, word: str) -> list[str]:
        parts = list(word)
        while len(parts) > 1:
            ranked = [(self.rank[pair], k) for k, pair in enumerate(zip(parts, parts[1:])) if pair in self.rank]
            if not ranked:
                break
            k = min(ranked)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _word(self, word: str) -> list[int]:
        """The ids of one word, kept for a bounded number of short ones."""
        ids = [self.vocab.get(p, self.special.get("[UNK]")) for p in self.pieces(word)]
        ids = [i for i in ids if i is not None]
        if len(word) <= LONGEST:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids; between [CLS] and [SEP] if there are special tokens. Unknown pieces are [UNK], or left out without it."""
        words = words_marked(text) if self.marked else words_simple(text)
        ids = [i for w in words for i in self.known.get(w) or self._word(w)]
        ends = [[self.special[name]] if name in self.special else [] for name in SPECIAL[:2]]
        return [*ends[0], *ids, *ends[1]]

    def decode(self, ids: list[int]) -> str:
        skipped = {i for name, i in self.special.items() if name != "[UNK]"}
        return "".join(self.token.get(i, "") for i in ids if i not in skipped).replace(START, " ")


#: Characters of text whose ids a worker holds at once.
CHARACTERS = 1_000_000


def ids_in_pieces(batches: Iterator[pa.Array], tokenizer: Tokenizer) -> Iterator[pa.Array]:
    """The ids of all texts in order, handed on after each ``CHARACTERS`` of text."""
    for texts in batches:
        ids, held = [], 0
        for text in texts:
            text = text.as_py() or ""
            ids.append(np.array(tokenizer.encode(text), np.int32))
            held += len(text)
            if held >= CHARACTERS:
                yield pa.array(ids, pa.list_(pa.int32()))
                ids, held = [], 0
        if ids:
            yield pa.array(ids, pa.list_(pa.int32()))


def encoded_ids(text: Column, tokenizer: Tokenizer) -> Column:
    """The ids of a text column; a worker holds those of few texts at once."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from ids_in_pieces(batches, tokenizer)

    return run(text)


def decoded_text(ids: Column, tokenizer: Tokenizer) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield lists.map(lambda x: tokenizer.decode(list(x)) if x is not None else "")

    return run(ids)


def simple_words(text: Column) -> Column:
    """``words_simple`` by a built-in function."""
    return F.regexp_extract_all(text, F.lit(SIMPLE), F.lit(0))
