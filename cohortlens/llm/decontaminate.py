"""Benchmark decontamination with suffix arrays over shards of the training texts.

The words of consecutive documents make a shard. Its suffix array is built by packing the ranks of the first words of
each suffix into one integer, sorting, and refining only the tied suffixes by rank doubling until they differ or are
as long as the longest benchmark item. All suffixes of all items are then searched at once, one word deeper at a time,
each by binary search in the range that its prefix left. That gives the longest verbatim match of each suffix in the
shard and, at the depth of a window, every place where the window occurs.

Shards are independent, so the work is one narrow pass over the documents. The benchmark is shipped to the tasks in
blocks of a bounded number of words; more blocks are more passes inside the same job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.layout import bounded, row_schema, wrapped
from cohortlens.llm.words import as_bytes, cut, groups

#: Words of a shard: bounds the memory of a task. A longer document is cut into overlapping shards.
SHARD_WORDS = 1_000_000
#: Words of the benchmark that are searched at a time.
BLOCK_WORDS = 4_000_000
#: Blocks that may be shipped to the tasks; a larger benchmark is to be given in parts.
MOST_BLOCKS = 8


@dataclass(frozen=True)
class Items:
    """Words of the benchmark items, one item after the other."""

    ids: list
    words: np.ndarray  # hashes
    item: np.ndarray  # item index of each word
    left: np.ndarray  # words from here to the end of the item
    window: np.ndarray  # window length at each word; 0 where none begins


def load_items(benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int = 10) -> list[Items]:
    """The benchmark in blocks of at most BLOCK_WORDS words (a longer item is a block of its own).

    A window begins at each of the first n - window + 1 words of an item; an item of fewer words is one window. Items
    without a word (or null) have none. Rows with the same id count as one item. A benchmark that could need more than
    MOST_BLOCKS blocks is an error, as it would not fit the driver and the tasks.
    """
    size = F.coalesce(F.length(text), F.lit(0))
    total = benchmark.select(F.sum(size).alias("n")).first()["n"] or 0
    blocks = 1 + total // (2 * BLOCK_WORDS)  # a word and its gap are two characters at least
    if blocks > MOST_BLOCKS:
        raise ValueError(f"a benchmark of {total} characters: give it in parts of {2 * MOST_BLOCKS * BLOCK_WORDS} at most")
    out = []
    for i in range(blocks):
        part = benchmark.select(F.col(key).alias("key"), F.col(text).alias("text"))
        if blocks > 1:
            part = part.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i)
        rows = sorted(((r["key"], r["text"]) for r in part.collect()), key=lambda r: (str(r[0]), r[1] or ""))
        h, which, _, _ = cut([(t or "").encode() for _, t in rows])
        n = np.bincount(which, minlength=len(rows)) if len(rows) else np.zeros(0, np.int64)
        start = np.cumsum(n) - n
        left = n[which] - (np.arange(len(h)) - start[which])
        long = n[which] >= window
        first = np.arange(len(h)) == start[which]
        out.append(Items([k for k, _ in rows], h, which, left,
                         np.where(long, np.where(left >= window, window, 0), np.where(first, n[which], 0))))
    return out


def suffix_array(rank: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``rank`` (0 ends a document) in the order of their first ``depth`` words."""
    n = len(rank)
    bits = max(int(rank.max()).bit_length(), 1) if n else 1
    packed = max(63 // bits, 1)
    key = np.zeros(n, np.int64)
    for j in range(packed):
        key <<= bits
        key[:max(n - j, 0)] |= rank[j:]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
    place = np.empty(n, np.int64)  # of each suffix: where its group of equal prefixes begins
    place[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    known = packed
    while known < depth:
        alone = new & np.concatenate([new[1:], [True]])
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        tied = order[at]
        group = place[tied]
        ahead = np.where(tied + known < n, place[np.minimum(tied + known, n - 1)] + 1, 0)
        by = np.argsort(group * (n + 1) + ahead, kind="stable")
        order[at] = tied[by]
        group, ahead = group[by], ahead[by]
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])])
        new[at] = fresh
        place = place.copy()
        place[order[at]] = np.maximum.accumulate(np.where(fresh, at, 0))
        known *= 2
    return order


def _bounds(words: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int,
            target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In each range [low, high) of suffixes with a common prefix: those whose word at ``depth`` is ``target``."""
    ends = []
    for right in (False, True):
        a, b = low.copy(), high.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            word = words[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, len(words) - 1)]
            go = open_ & ((word <= target) if right else (word < target))
            a, b = np.where(go, mid + 1, a), np.where(open_ & ~go, mid, b)
        ends.append(a)
    return ends[0], ends[1]


@dataclass(frozen=True)
class Found:
    """Occurrences of windows: item word index and word place in the shard."""

    at: np.ndarray
    place: np.ndarray


def search(words: np.ndarray, items: Items) -> tuple[Found, np.ndarray]:
    """All window occurrences in a shard, and the longest verbatim match of each item suffix.

    ``words``: hashes of the shard's words; 0 ends a document.
    """
    longest = np.zeros(len(items.words), np.int64)
    if not len(items.words) or not len(words):
        return Found(np.zeros(0, np.int64), np.zeros(0, np.int64)), longest
    known, rank = np.unique(words, return_inverse=True)
    if known[0] != 0:
        rank = rank + 1
        known = np.concatenate([np.zeros(1, np.uint64), known])
    at = np.searchsorted(known, items.words)
    at = np.where(at < len(known), at, 0)
    target = np.where(known[at] == items.words, at, -1)  # -1: the shard has no such word
    order = suffix_array(rank, int(items.left.max()))
    active = np.flatnonzero(target >= 0)
    low, high = np.zeros(len(active), np.int64), np.full(len(active), len(order))
    found_at, found_place = [], []
    depth = 0
    while len(active):
        low, high = _bounds(rank, order, low, high, depth, target[active + depth])
        some = low < high
        active, low, high = active[some], low[some], high[some]
        depth += 1
        longest[active] = depth
        hit = np.flatnonzero(items.window[active] == depth)
        if len(hit):
            n = high[hit] - low[hit]
            found_at.append(np.repeat(active[hit], n))
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            found_place.append(order[np.repeat(low[hit], n) + inside])
        go = items.left[active] > depth
        active, low, high = active[go], low[go], high[go]
        more = target[active + depth] >= 0
        active, low, high = active[more], low[more], high[more]
    none = [np.zeros(0, np.int64)]
    return Found(np.concatenate(found_at or none), np.concatenate(found_place or none)), longest


def _shards(texts: list[bytes], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words with 0 behind each document, text index, word place in its document) of each shard."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate([h[i] for h in held]) for i in range(3))

    for first, end in groups(texts):
        h, which, _, _ = cut(texts[first:end])
        bounds = np.searchsorted(which, np.arange(end - first + 1))
        for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            for s in range(0, max(b - a, 1), SHARD_WORDS):
                own = h[a + s:min(b, a + s + SHARD_WORDS + overlap)]
                if size + len(own) > SHARD_WORDS + overlap and held:
                    yield joined()
                    held, size = [], 0
                n = len(own) + 1
                held.append((np.append(own, np.uint64(0)), np.full(n, first + i), np.arange(s, s + n)))
                size += n
    if held:
        yield joined()


def hits(texts: list[bytes], blocks: list[Items]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set]]:
    """For each text: its number of words, the merged spans [first, end) of hit words, and the occurring items."""
    n_words = np.zeros(len(texts), np.int64)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    reach = max((int(b.window.max()) for b in blocks if len(b.window)), default=1)
    for words, doc, place in _shards(texts, reach - 1):
        real = words != 0
        np.maximum.at(n_words, doc[real], place[real] + 1)
        cover = np.zeros(len(words) + 1, np.int64)
        for block in blocks:
            found, _ = search(words, block)
            np.add.at(cover, found.place, 1)
            np.add.at(cover, found.place + block.window[found.at], -1)
            for d, i in set(zip(doc[found.place].tolist(), block.item[found.at].tolist(), strict=True)):
                if block.ids[i] is not None:
                    items[d].add(block.ids[i])
        inside = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            spans[doc[a]].append((int(place[a]), int(place[b - 1]) + 1))
    for i, own in enumerate(spans):
        merged: list[tuple[int, int]] = []
        for a, b in sorted(own):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        spans[i] = merged
    return n_words, spans, items


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text",
                    item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Longest verbatim matches of at least a window, with their locations.

    A row for each maximal run of matching words: key, item_id (string), item_start, doc_start, length (words from 0).
    Documents without such a match have no row. The matches of an item without an id have a null item_id.
    """
    blocks = load_items(benchmark, item_key, item_text, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out = b.column(0).to_pylist(), set()
            runs: dict[tuple, list[tuple[int, int]]] = {}  # (text, block, item, diagonal): spans in the document
            names: dict[tuple, str | None] = {}
            for words, doc, place in _shards(as_bytes(b.column(1)), window - 1):
                for number, block in enumerate(blocks):
                    f, _ = search(words, block)
                    # windows on the same diagonal that follow each other are one match
                    by = np.lexsort((f.place, f.at - f.place))
                    at, p = f.at[by], f.place[by]
                    new = np.concatenate([[True], (np.diff(p) != 1) | (np.diff(at) != 1)
                                          | (np.diff(block.item[at]) != 0)]) if len(p) else np.zeros(0, bool)
                    first = np.flatnonzero(new)
                    for i, n in zip(first, np.diff(np.append(first, len(p))), strict=True):
                        item = block.item[at[i]]
                        base = at[i] - np.searchsorted(block.item, item)
                        name = block.ids[item]
                        start = int(place[p[i]])
                        runs.setdefault((int(doc[p[i]]), number, int(item), start - int(base)), []).append(
                            (start, start + int(n) - 1 + int(block.window[at[i]])))
                        names[number, int(item)] = None if name is None else str(name)
            for (d, number, item, diagonal), own in runs.items():  # spans of a diagonal are equal words, so those that touch are one
                merged: list[list[int]] = []
                for x, y in sorted(own):
                    if merged and x <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], y)
                    else:
                        merged.append([x, y])
                out |= {(d, names[number, item], x - diagonal, x, y - x) for x, y in merged}
            rows = sorted(out, key=lambda r: (r[0], r[1] or "", r[2:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[r[0]] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.string()),
                 *(pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3, 4))],
                names=["key", "item_id", "item_start", "doc_start", "length"])

    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return bounded(src).mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, item_id string, item_start bigint, "
                               "doc_start bigint, length bigint").withColumnRenamed("key", key)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", batch_bytes: int = 8 << 20) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), n_words, n_hit, n_items and items_sha256.

    A word is hit if it lies in any occurrence of a window of any item. Null and empty texts have no words. Repeated
    rows are judged alike and all stay. An empty benchmark hits nothing; an empty table gives no rows. Extra columns
    of any name pass through inside ``row``. items_sha256 is that of the occurring item ids, sorted as strings,
    comma-joined (of the empty string if none occurs). The windows of an item without an id hit words, but the item is
    not in n_items and items_sha256.
    """
    blocks = load_items(benchmark, item_key, item_text, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = as_bytes(whole.column(0).field(text))
            for first, end in groups(texts, batch_bytes):
                n_words, spans, items = hits(texts[first:end], blocks)
                digest = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items]
                yield pa.RecordBatch.from_arrays(
                    [whole.column(0).slice(first, end - first), pa.array(n_words, pa.int64()),
                     pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()),
                     pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string())],
                    names=["row", "n_words", "n_hit", "n_items", "items_sha256"])

    return wrapped(docs).mapInArrow(run, row_schema(
        docs, "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string"))
