"""Chunks of notes as offset ranges (M3): sub-word tokens, both orders of prompt and note.

A tokenizer gives the character range of each token. One Arrow pass turns a note into the ranges of its chunks, a few
numbers each; the token offsets stay in the pass, and the text of a chunk is ``substring(note, start + 1, length)``, which
Spark takes where it is needed. As in the reference, the note is truncated and never the prompt, neighbouring chunks
share ``stride`` tokens, and a note of no tokens is one empty chunk. With ``note_first`` the note stands before the prompt
and the tokenizer's own ``model_max_length`` holds, whatever ``max_length`` says.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.predict import MAX_LENGTH, PRED_KEY, STRIDE

_RANGES = pa.list_(pa.struct([("budget", pa.int32()), ("chunk_idx", pa.int32()), ("n_tokens", pa.int32()),
                              ("start", pa.int32()), ("length", pa.int32())]))
_RANGES_DDL = "array<struct<budget:int,chunk_idx:int,n_tokens:int,start:int,length:int>>"

#: Notes and bytes of text that are tokenized at a time: a token's range is some 150 bytes of Python objects, a chunk's
#: some 400, so no more of a batch than this is held as such (one longer note is a part by itself).
PART_NOTES, PART_BYTES = 64, 256 << 10


class OffsetTokenizer(Protocol):
    """What chunking needs of a tokenizer."""

    model_max_length: int
    #: Tokens that the model's own marks take in an input of prompt and note.
    marks: int

    def offsets(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Character range (start, end) of each token of each text."""


@dataclass(frozen=True)
class RegexTokenizer:
    """Tokens are the matches of a pattern; the default cuts words into pieces of six letters, numbers into three
    digits, and takes each other sign by itself."""

    pattern: str = r"[A-Za-z]{1,6}|[0-9]{1,3}|[^\x20\x09-\x0DA-Za-z0-9]"
    model_max_length: int = MAX_LENGTH
    marks: int = 0

    def offsets(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        rx = re.compile(self.pattern)
        return [[m.span() for m in rx.finditer(t)] for t in texts]


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@dataclass(frozen=True)
class FileTokenizer:
    """A public sub-word tokenizer file (``.json`` of the tokenizers library) at ``path``, loaded in the workers."""

    path: str
    model_max_length: int = MAX_LENGTH
    marks: int = 2

    def offsets(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        return [e.offsets for e in _library(self.path).encode_batch(texts, add_special_tokens=False)]


def note_budget(prompt: str, tokenizer: OffsetTokenizer, max_length: int = MAX_LENGTH, stride: int = STRIDE,
                note_first: bool = False) -> int:
    """Tokens that a chunk of a note may have beside ``prompt``."""
    room = (tokenizer.model_max_length if note_first else max_length) - tokenizer.marks
    budget = room - len(tokenizer.offsets([prompt])[0])
    if budget <= stride:
        raise ValueError("the prompt leaves no room for the note at this length and stride")
    return budget


def ranges_of(spans: list[tuple[int, int]], budget: int, stride: int) -> list[tuple[int, int]]:
    """(start, length) in characters of the chunks of ``budget`` tokens that overlap by ``stride``."""
    if not spans:
        return [(0, 0)]
    out, first = [], 0
    while True:
        last = min(first + budget, len(spans))
        out.append((spans[first][0], spans[last - 1][1] - spans[first][0]))
        if last == len(spans):
            return out
        first += budget - stride


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of ``texts`` of at most PART_NOTES notes and, if they have more than one, PART_BYTES bytes."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
    first = 0
    while first < len(ends):
        before = int(ends[first - 1]) if first else 0
        fit = int(np.searchsorted(ends, before + PART_BYTES, side="right"))
        last = max(first + 1, min(fit, first + PART_NOTES))
        yield texts.slice(first, last - first)
        first = last


def _ranges_of_part(part: pa.Array, tokenizer: OffsetTokenizer, budgets: list[int], stride: int) -> pa.Array:
    found = part.to_pylist()
    out: list[list[dict] | None] = [None] * len(found)
    known = [i for i, t in enumerate(found) if t is not None]
    for i, spans in zip(known, tokenizer.offsets([found[i] for i in known]), strict=True):
        out[i] = [{"budget": b, "chunk_idx": k, "n_tokens": len(spans), "start": start, "length": length}
                  for b in budgets for k, (start, length) in enumerate(ranges_of(spans, b, stride))]
    return pa.array(out, _RANGES)


def chunk_ranges(text: Column, tokenizer: OffsetTokenizer, budgets: list[int], stride: int = STRIDE) -> Column:
    """Array of (budget, chunk_idx, n_tokens, start, length) of a text for each budget; null text: null."""
    budgets = sorted(set(budgets))

    @F.arrow_udf(_RANGES_DDL)
    def ranges(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], _RANGES), *(_ranges_of_part(part, tokenizer, budgets, stride) for part in _parts(texts))])

    return ranges(text)


def chunk_text(text: Column, start: Column, length: Column) -> Column:
    """The characters of a range."""
    return F.substring(text, start + 1, length)


def model_input(prompt: Column, chunk: Column, note_first: bool = False) -> Column:
    """What a model reads: prompt and chunk in their order."""
    return F.concat(chunk, F.lit("\n"), prompt) if note_first else F.concat(prompt, F.lit("\n"), chunk)


def chunk_notes_offsets(notes: DataFrame, prompt: str, tokenizer: OffsetTokenizer, max_length: int = MAX_LENGTH,
                        stride: int = STRIDE, note_first: bool = False, text: str = "Report_Text",
                        key: list[str] | None = None) -> DataFrame:
    """One row per chunk: key, chunk_idx, n_tokens (of the note), start, length (characters), chunk_text.

    Notes without text have no chunk. No shuffle; a note's text stands once in its row and its chunks are cut from it."""
    key = [c for c in (key or PRED_KEY) if c in notes.columns]
    budget = note_budget(prompt, tokenizer, max_length, stride, note_first)
    src = notes.where(F.col(text).isNotNull()).select(
        *key, F.col(text).alias("_text"), chunk_ranges(F.col(text), tokenizer, [budget], stride).alias("_ranges"))
    cut = F.transform("_ranges", lambda c: F.struct(
        c["chunk_idx"].alias("chunk_idx"), c["n_tokens"].alias("n_tokens"), c["start"].alias("start"),
        c["length"].alias("length"), chunk_text(F.col("_text"), c["start"], c["length"]).alias("chunk_text")))
    return src.select(*key, F.inline(cut))
