"""Token counts by dynamic programming over prefixes.

For a vocabulary whose merges follow the pieces' scores, a sequence of pieces is an encoding just
if each neighbouring pair is. So the encoding of a prefix ends in the one piece that is compatible
with the end of the encoding of what stands before it, and its count is one more. One pass fills
in the exact count at every prefix; questions about truncation and budgets then read the table.

No piece of such a vocabulary has a space mark after another character, so a text falls apart
before each run of spaces, and the parts are counted once and remembered in a bounded table.
"""

from __future__ import annotations

import functools
import gc
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Remembered, text_or_empty

#: Fixed: the mark that stands for a space.
MARK = "▁"
#: Parts and pairs that a worker remembers at once.
REMEMBERED = 500_000
PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PrefixCounter:
    """Exact token counts at all prefixes, for a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in usual}
        if any(MARK in piece.lstrip(MARK) for piece in self.score):
            raise ValueError("a model whose pieces hold space marks at their start only is needed")
        self.piece = list(self.score)
        self.size = len(self.piece)
        self.letters = {piece for piece in self.piece if len(piece) == 1}
        self.matcher = ahocorasick.Automaton()
        for i, piece in enumerate(self.piece):
            if self.merged(piece) == [piece]:  # others never come out of the merges
                self.matcher.add_word(piece, (len(piece), i))
        self.matcher.make_automaton()
        #: By left * size + right, if the merges leave such a pair as it is.
        self.pairs = Remembered(self._compatible, REMEMBERED)
        #: By word, the count of a space mark and the word.
        self.words = Remembered(lambda word: self.part_counts(MARK + word)[-1], REMEMBERED)

    def merged(self, string: str) -> list[str]:
        """The merges, run one by one, best score first and then leftmost. For short strings only."""
        parts = list(string)
        while len(parts) > 1:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
            k = max(range(len(scores)), key=scores.__getitem__)
            if scores[k] == -np.inf:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _compatible(self, pair: int) -> bool:
        left, right = self.piece[pair // self.size], self.piece[pair % self.size]
        return self.merged(left + right) == [left, right]

    def part_counts(self, part: str) -> list[int]:
        """Counts after each character of a part that starts where a text may fall apart.

        Entry i holds the last piece of the encoding of the first i characters and its count. A
        character that the vocabulary lacks is spelt in bytes and merges with nothing, so any
        piece may stand before and after it (piece -1, as at the start).
        """
        last, counts = [-2] * (len(part) + 1), [0] * (len(part) + 1)
        last[0] = -1
        pairs, size = self.pairs, self.size
        if self.letters.issuperset(part):
            runs = [(0, part)]
        else:
            runs = [(m.start(), m[0]) for m in re.finditer("[^\0]+", "".join(c if c in self.letters else "\0" for c in part))]
        done = 0
        for offset, run in runs:
            for i in range(done, offset):
                last[i + 1], counts[i + 1] = -1, counts[i] + len(part[i].encode())
            for end, (length, piece) in self.matcher.iter(run):
                end += offset + 1
                if last[end] != -2:
                    continue
                before = last[end - length]
                if before < 0 or pairs[before * size + piece]:
                    last[end], counts[end] = piece, counts[end - length] + 1
            done = offset + len(run)
        for i in range(done, len(part)):
            last[i + 1], counts[i + 1] = -1, counts[i] + len(part[i].encode())
        return counts[1:]

    def parts_of(self, text: str) -> list[str]:
        return PART.findall(MARK + text.replace(" ", MARK)) if text else []

    def count(self, text: str) -> int:
        if text and "  " not in text and MARK not in text and text[0] != " " != text[-1]:
            return sum(map(self.words.__getitem__, text.split(" ")))
        return sum(self.words[part[1:]] for part in self.parts_of(text))

    def prefix_counts(self, text: str) -> np.ndarray:
        """The count of ``text[:i]`` for each i from 0 to the length."""
        out, total = [], 0
        for part in self.parts_of(text):
            counts = self.part_counts(part)
            out += [total + n for n in counts]
            total += counts[-1]
        return np.array([0, *out[1:]], np.int64)  # the first mark is not of the text

    @staticmethod
    def fits(counts: np.ndarray, budget: int) -> int:
        """The length of the longest prefix with at most ``budget`` tokens."""
        return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


@functools.lru_cache(2)
def counter(path: str) -> PrefixCounter:
    """One for each model and worker."""
    made = PrefixCounter(path)
    gc.freeze()  # the tables live as long as the worker
    return made


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, budgets: tuple[int, ...] = (), keep_counts: bool = False) -> DataFrame:
    """Token counts of whole texts.

    ``path`` names a model file that every executor can read. Returns a row for each row of
    ``docs``: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit``),
    with ``budgets`` also ``fits``, an array with the length in code points of the longest prefix
    within each of them, and with ``keep_counts`` ``prefix_counts``, the count at each prefix. Both
    come from one table without encoding again. A null text counts as empty and has no tokens,
    repeated rows and null ids stay, an empty table gives an empty one, other columns are not read.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    id_type = chosen.schema["doc_id"].dataType.simpleString()
    extra = [("fits", "array<bigint>")] * bool(budgets) + [("prefix_counts", "array<bigint>")] * keep_counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(path)
        for batch in batches:
            sizes, counts, fits, tables = [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                sizes.append(len(text.encode()))
                if extra:
                    at = prefixes.prefix_counts(text)
                    counts.append(int(at[-1]))
                    fits.append([prefixes.fits(at, n) for n in budgets])
                    tables.append(at)
                else:
                    counts.append(prefixes.count(text))
            numbers = pa.array(counts, pa.int64())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), numbers, pa.array([n > limit for n in counts], pa.bool_())]
            columns += [pa.array(fits, pa.list_(pa.int64()))] * bool(budgets) + [pa.array(tables if keep_counts else [], pa.list_(pa.int64()))] * keep_counts
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", *(name for name, _ in extra)])

    schema = f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return chosen.mapInArrow(run, ", ".join([schema, *(f"{name} {kind}" for name, kind in extra)]))
