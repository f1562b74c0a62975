"""Token counts of whole texts with a public tokenizer (never trained here).

A text of up to ``chunk`` characters is encoded at once. A longer one is encoded in overlapping chunks with offsets:
the counts of two neighbouring chunks are spliced at a proven stable common boundary in their overlap, and where there
is none, the overlap is widened and the chunk encoded anew, up to the whole rest of the text.

Why a splice is exact: the tokenizer cuts a text into special strings and pieces from left to right, and merges never
cross pieces. If both chunks begin a piece at character p, both have scanned the same text from p on, as long as
p is at least ``margin`` characters (more than the longest special string or contraction) before the end of the left
chunk, so that the left chunk's pieces before p cannot change with more text, and the character at p does not
compose with the one before it.

Where a tokenizer provably isolates what stands between white space (it drops white space and cuts there, and no
special string contains any), the texts that need no chunks are counted by their distinct space-separated runs, each
encoded once by the library in a task. Closing punctuation behind a letter or digit begins a piece of its own, so it
is counted apart from the word before it, and ASCII words are lower-cased first if the tokenizer does that anyway.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.layout import bounded

#: Characters before the end of a chunk where pieces can still change, besides the longest special string.
MARGIN = 8
#: ASCII punctuation that composes with no mark and begins no contraction or special string.
CLOSING = ".,;:!?|*$%&#"
#: Distinct runs that a task keeps with their counts; beyond, the memo starts anew (memory bound, same counts).
MEMO = 1_000_000


@lru_cache(maxsize=4)
def load(path: str):
    """The library's tokenizer for a ``.json`` file, without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def isolates_space(path: str) -> bool:
    """Whether the file's pre-tokenizer keeps only pieces without white space, and no special string has any."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if any(any(c.isspace() for c in a["content"]) or a["lstrip"] or a["rstrip"] or a["single_word"]
           for a in spec.get("added_tokens") or ()):
        return False
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    first = steps[0]
    normal = spec.get("normalizer") or {}
    known = {"NFC", "Lowercase", "Replace"}
    return (first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
            and first["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
            and {"Lowercase"} <= {n["type"] for n in normal.get("normalizers", [])} <= known
            and all(n["pattern"] == {"Regex": r"\s+"} and n["content"] == " "
                    for n in normal.get("normalizers", []) if n["type"] == "Replace"))


def piece_starts(encoding) -> tuple[np.ndarray, np.ndarray]:
    """Characters at which a piece begins, and how many tokens stand before each, in order."""
    if not len(encoding):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.array([o[0] for o in encoding.offsets], np.int64)
    word = np.array([-1 - i if w is None else w for i, w in enumerate(encoding.word_ids)], np.int64)
    new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) & (begin[1:] > begin[:-1])]))
    return begin[new], new


def count_chunked(tokenizer, text: str, chunk: int, overlap: int) -> int:
    """Tokens of ``text`` from overlapping chunks; equal to encoding it whole."""
    margin = MARGIN + max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)
    encode = tokenizer.encode
    total, begin, end = 0, 0, chunk
    left = encode(text[:end], add_special_tokens=False)
    skip = 0  # tokens of ``left`` that are counted already
    while end < len(text):
        here, before = piece_starts(left)
        wide = overlap
        while True:
            start = max(end - wide, begin)
            right_end = min(max(start, end) + chunk, len(text))
            right = encode(text[start:right_end], add_special_tokens=False)
            there, ahead = piece_starts(right)
            common, i, j = np.intersect1d(here + begin, there + start, return_indices=True)
            ok = [k for k in range(len(common)) if common[k] <= end - margin and before[i[k]] >= skip
                  and common[k] > start and not unicodedata.combining(text[common[k]])]
            if ok:
                k = ok[-1]
                total += int(before[i[k]]) - skip
                skip, left, begin, end = int(ahead[j[k]]), right, start, right_end
                break
            if start == begin:  # no boundary in all that the left chunk holds: it goes on to the right chunk's end
                left, end = encode(text[begin:right_end], add_special_tokens=False), right_end
                break
            wide *= 2
    return total + len(left) - skip


def _parts(run: str) -> tuple[str, str]:
    """A run as (word, closing punctuation): their counts add up to that of the run."""
    word = run.rstrip(CLOSING)
    if word and len(word) < len(run) and not (word[-1].isalnum() and len(word[-1].lower()) == 1):
        return run, ""
    if not word:
        return run, ""
    return word.lower() if word.isascii() and "<" not in word else word, run[len(word):]


def _learn(tokenizer, runs: set[str], memo: dict[str, int]) -> None:
    """Put the counts of ``runs`` into ``memo``."""
    parts = {r: _parts(r) for r in runs}
    new = list({x for pair in parts.values() for x in pair if x})
    count = {"": 0}
    for first in range(0, len(new), 4096):
        part = new[first:first + 4096]
        count.update(zip(part, map(len, tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
    memo.update((r, count[word] + count[tail]) for r, (word, tail) in parts.items())


def count_tokens(texts: list[str | None], path: str, chunk: int, overlap: int, memo: dict[str, int]) -> list[int]:
    """Tokens of each whole text (null: 0). ``memo``: counts of runs, kept by the caller between batches."""
    tokenizer = load(path)
    out = [0] * len(texts)
    small = [i for i, t in enumerate(texts) if t and len(t) <= chunk]
    if isolates_space(path):
        runs = [texts[i].replace("\n", " ").split(" ") for i in small]
        distinct = set().union(*runs)
        new = distinct.difference(memo)
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = distinct
        _learn(tokenizer, new, memo)
        for i, own in zip(small, runs, strict=True):
            out[i] = sum(map(memo.__getitem__, own))
    else:
        for first in range(0, len(small), 64):
            part = small[first:first + 64]
            found = tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)
            for i, e in zip(part, found, strict=True):
                out[i] = len(e)
    for i, t in enumerate(texts):
        if t and len(t) > chunk:
            out[i] = count_chunked(tokenizer, t, chunk, overlap)
    return out


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 2048,
                 chunk: int = 65_536, overlap: int = 512, batch_chars: int = 4_000_000) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) for each row.

    Null and empty texts have 0 bytes and tokens. Repeated rows are counted alike and all stay; an empty table gives
    no rows; other columns are not read. One narrow pass, no shuffle; a task holds the tokens of one chunk, and of
    about ``batch_chars`` characters of shorter texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for b in batches:
            texts = b.column(1).to_pylist()
            found, first, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= batch_chars or i + 1 == len(texts):
                    found += count_tokens(texts[first:i + 1], path, chunk, overlap, memo)
                    first, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.int64())],
                                             names=["key", "n_bytes", "n_tokens"])

    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"),
                      F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    out = bounded(src).mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
