"""Stupid-backoff language-model scores of whole documents against the rest of the corpus.

The n-gram counts of the whole corpus are a table partitioned by hash. A document's n-grams are joined to it, and the
scores are summed per document. Its own occurrences are taken off the counts first, so that a document is judged by the
others: an n-gram that occurs nowhere else backs off to the next shorter one, with a factor of ``alpha`` each time; a
word that occurs nowhere else gets alpha / (words of the corpus).

How the join stays small: documents are dealt into blocks. A block sends its distinct n-grams (64-bit hashes, with
their counts in it) to the hash partitions as packed arrays; a partition adds up the counts of all blocks and sends
each block its counts back, in the same order and without the hashes; the block, which still has its documents, finds
the count of each n-gram and adds up the scores. Rows of the exchange are arrays, one for each pair of block and
partition, and no hot word or n-gram is more than one entry of a block.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.layout import bounded, counted_copies, repeated
from cohortlens.llm.words import cut, groups, mix

_ROTATE = np.uint64(0xD6E8FEB86659FD93)


def _grams(words: np.ndarray, which: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``order``-grams, and the place of the last word of each."""
    h = words
    for n in range(1, order):
        h = mix(h[:-1] * _ROTATE + words[n:])
    same = which[order - 1:] == which[:len(which) - order + 1] if order > 1 else np.ones(len(words), bool)
    return h[same], np.flatnonzero(same) + order - 1


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words, which = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, end in groups(texts):
        h, w, _, _ = cut(texts[first:end])
        words.append(h)
        which.append(w + first)
    return np.concatenate(words), np.concatenate(which)


def _block_grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Word hashes, the text index of each word, and for each order the n-grams with the places they end at."""
    words, which = _words_of(texts)
    per_order = []
    for n in range(1, order + 1):
        h, at = _grams(words, which, n) if len(words) >= n else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        per_order.append((h ^ np.uint64(n), at))
    return words, which, per_order


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64)


def _merged(b: pa.Table) -> tuple[list, list[bytes], np.ndarray]:
    """Keys and texts of the distinct rows of a block, and how often each occurs."""
    times: dict[tuple, int] = {}
    for k, data, n in zip(*(b[c].to_pylist() for c in ("key", "data", "copies")), strict=True):
        times[k, data] = times.get((k, data), 0) + max(n, 1)
    return [k for k, _ in times], [zlib.decompress(x) for _, x in times], np.array(list(times.values()), np.int64)


def _own_counts(grams: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Of each n-gram occurrence: how often the n-gram occurs in the same text."""
    by = np.lexsort((grams, which))
    new = np.ones(len(by), bool)
    new[1:] = (np.diff(which[by]) != 0) | (grams[by][1:] != grams[by][:-1])
    run = np.cumsum(new) - 1
    out = np.empty(len(by), np.int64)
    out[by] = np.bincount(run, minlength=1)[run]
    return out


def _partition_edges(parts: int) -> np.ndarray:
    """Hash ranges of the partitions: the first hash of each but the first."""
    return np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)


def block_texts(docs: DataFrame, blocks: int, key: str, text: str) -> DataFrame:
    """(block, key, data, copies, spread): documents dealt into blocks by a hash of key and text, texts compressed.

    Equal rows are in one block, but a task sends them as few rows with their number (see ``counted_copies``).
    """
    src = docs.select(F.pmod(F.xxhash64(key, text), F.lit(blocks)).cast("int").alias("block"),
                      F.col(key).alias("key"), F.col(text).alias("text"))
    return bounded(src).mapInArrow(
        counted_copies, f"block int, key {src.schema['key'].dataType.simpleString()}, data binary, copies bigint, "
                        "spread int").repartition(blocks, "block")


def lm_scores(docs: DataFrame, blocks: int, order: int = 2, alpha: float = 0.4, key: str = "doc_id",
              text: str = "text") -> DataFrame:
    """key, n_words, n_backoff (words scored below the full order available to them) and score for each row.

    score: mean natural logarithm of the stupid-backoff score of the words (0.0 without words). The first words of a
    document have the n-grams that fit. Null and empty texts have no words. Repeated rows are documents of their own:
    each counts for the others. An empty table gives no rows; other columns are not read.

    ``blocks`` should grow with the corpus (the session's shuffle partitions): a task holds the n-grams of a block, or
    those of a hash partition.
    """
    texts = block_texts(docs, blocks, key, text)
    edges = _partition_edges(blocks)

    def send(b: pa.Table) -> pa.Table:
        _, texts, times = _merged(b)
        words, which, per_order = _block_grams(texts, order)
        h, at = np.unique(np.concatenate([g for g, _ in per_order]), return_inverse=True)
        n = np.zeros(len(h), np.int64)
        np.add.at(n, at, times[np.concatenate([which[end] for _, end in per_order])])
        cuts = [0, *np.searchsorted(h, edges).tolist(), len(h)]
        spans = list(zip(cuts, cuts[1:], strict=False))
        return pa.table({"block": pa.array([b["block"][0].as_py()] * len(spans), pa.int32()),
                         "part": pa.array(range(len(spans)), pa.int32()),
                         "grams": pa.array([h[x:y].tobytes() for x, y in spans], pa.binary()),
                         "counts": pa.array([_pack(n[x:y].astype(np.int64)) for x, y in spans], pa.binary()),
                         "words": pa.array([int(times[which].sum())] * len(spans), pa.int64())})

    def total(b: pa.Table) -> pa.Table:
        h = [np.frombuffer(x, np.uint64) for x in b["grams"].to_pylist()]
        n = np.concatenate([_unpack(x) for x in b["counts"].to_pylist()])
        known, at = np.unique(np.concatenate(h), return_inverse=True)
        everywhere = np.zeros(len(known), np.int64)
        np.add.at(everywhere, at, n)
        ends = np.cumsum([len(x) for x in h])
        # every block sends a row to every partition, so each knows the words of the whole corpus
        corpus = sum(b["words"].to_pylist())
        return pa.table({"block": b["block"], "part": b["part"],
                         "totals": pa.array([_pack(x) for x in np.split(everywhere[at], ends[:-1])], pa.binary()),
                         "corpus": pa.array([corpus] * len(h), pa.int64())})

    def score(own: pa.Table, back: pa.Table) -> pa.Table:
        keys, texts, times = _merged(own)
        words, which, per_order = _block_grams(texts, order)
        h = np.unique(np.concatenate([g for g, _ in per_order]))
        order_of_parts = np.argsort(back["part"].to_numpy())
        totals = back["totals"].to_pylist()
        got = np.concatenate([_unpack(totals[i]) for i in order_of_parts])
        if len(got) != len(h):
            raise RuntimeError("a block came back with other n-grams than it sent")
        n_words = np.bincount(which, minlength=len(keys))
        others = np.maximum(back["corpus"][0].as_py() - n_words[which], 1)  # words of the other documents
        unknown = math.log(alpha) - np.log(others)
        value, level, most, context = unknown, np.zeros(len(words), np.int8), np.ones(len(words), np.int8), None
        for n, (g, at) in enumerate(per_order, 1):
            rest = np.zeros(len(words), np.int64)  # occurrences in other documents
            rest[at] = got[np.searchsorted(h, g)] - _own_counts(g, which[at])
            fits = np.zeros(len(words), bool)
            fits[at] = True
            below = others if n == 1 else np.maximum(np.concatenate([[0], context[:-1]]), 1)[:len(words)]
            seen = rest > 0
            backed_off = value if n == 1 else np.where(fits, value + math.log(alpha), value)
            value = np.where(seen, np.log(np.maximum(rest, 1)) - np.log(below), backed_off)
            level, most, context = np.where(seen, n, level), np.where(fits, n, most), rest
        return pa.table({
            "key": pa.array(keys, own["key"].type), "times": pa.array(times), "n_words": pa.array(n_words, pa.int64()),
            "n_backoff": pa.array(np.bincount(which, weights=level < most, minlength=len(keys)).astype(np.int64)),
            "score": pa.array(np.bincount(which, weights=value, minlength=len(keys)) / np.maximum(n_words, 1))})

    sent = texts.groupBy("block").applyInArrow(send, "block int, part int, grams binary, counts binary, words bigint")
    back = sent.repartition(blocks, "part").groupBy("part").applyInArrow(
        total, "block int, part int, totals binary, corpus bigint")
    kind = texts.schema["key"].dataType.simpleString()
    found = texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        score, f"key {kind}, times bigint, n_words bigint, n_backoff bigint, score double")
    return repeated(found, "times").select(F.col("key").alias(key), "n_words", "n_backoff", "score")
