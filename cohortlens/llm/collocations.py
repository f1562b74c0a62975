"""Collocations: phrases whose words come together more often than their parts would, counted from a suffix tree that
is cut at five words and built in independent parts (vertical partitioning by word prefixes).

1. One pass counts every word of every language, and one counts word pairs in a table of hashed counters, with more of
   them the more words there are. A pair whose counter is under ``min_count`` is surely rare, so no phrase that is wanted
   holds it.
2. Every position that starts a pair which may be frequent gives its suffix, up to five words and to the first surely
   rare pair. Equal suffixes are added up before they are shuffled, and written once.
3. Prefixes are grouped by a memory budget: a first word with more suffixes than its share becomes its prefixes of two
   words, and so on; prefixes are dealt to as many groups as the budget asks for. A group's subtree is built alone:
   its suffixes are sorted, the nodes of depth d are the runs of equal first d words, and a node's count is the total of
   the leaves below. Nodes above a split prefix were counted when it was split.
4. Scores, longer phrases with the same count, and ranks are joins and aggregations of the table of frequent nodes.

Words are 64-bit hashes of language and word until step 4; equal hashes of different words are looked for and are an
error. The counters only save work: with more words than they can tell apart (the largest table fills up from some
2 x 10^9 on, for a ``min_count`` of 100), more suffixes are kept, at most one for each word, and counts are the same.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.layout import bounded
from cohortlens.llm.shared import written
from cohortlens.llm.words import mix

#: Words of the longest phrase; counters in a shuffled slice (bits).
DEPTH, SLICE_BITS = 5, 16
#: Bits of the least and the largest table of pair counters, which are bytes, so 16 and 128 MB in a task.
COUNTER_BITS, MOST_COUNTER_BITS = 24, 27
#: Suffixes that a group may hold (rows of 48 bytes), and the share of it beyond which a prefix is split.
BUDGET, SHARE = 2_000_000, 8
#: Most groups; with more suffixes the budget grows, so that the split prefixes, at most 4 x SHARE x this, stay bounded.
MOST_GROUPS = 1 << 16
#: Bytes of texts that are cut at a time.
GROUP_BYTES = 8 << 20
#: What stands between pieces, and between words.
PIECE_ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
W = [f"w{i}" for i in range(1, DEPTH + 1)]

_RNG = np.random.Generator(np.random.PCG64(20260317))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ENDS = np.isin(np.arange(256), np.frombuffer(PIECE_ENDS, np.uint8))
_INSIDE = ~(_ENDS | np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8)))


def cut(texts: list[bytes], langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Word hashes (of language and word), piece numbers, text numbers, (start, end) and the joined lower-case bytes."""
    joined = b"\n".join(texts).lower()
    data = np.frombuffer(joined, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _INSIDE[data], [False]]).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros((0, 2), np.int64), joined
    size = end - start
    first = np.cumsum(size) - size
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(size.max()) - 1, _STEP)]))
    value = _BYTE[data[_INSIDE[data]]] * power[np.arange(int(size.sum())) - np.repeat(first, size)]
    offsets = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    which = np.searchsorted(offsets, start, side="right")
    seed = np.fromiter((xxhash.xxh64_intdigest(x.encode(), 7) for x in langs), np.uint64, len(langs))
    h = mix(mix(np.add.reduceat(value, first) + size.astype(np.uint64)) ^ seed[which])
    h[h == 0] = 1  # zero stands for no word
    return h, np.cumsum(_ENDS[data])[start], which, np.stack([start, end], 1), joined


def _groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts and languages of about ``limit`` bytes together."""
    texts, langs, size = [], [], 0
    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            texts.append((text or "").encode())
            langs.append("und" if lang is None else lang)
            size += len(texts[-1])
            if size >= limit:
                yield texts, langs
                texts, langs, size = [], [], 0
    if texts:
        yield texts, langs


def _pairs(h: np.ndarray, piece: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word is followed by one of its piece, and the counter of that pair."""
    together = piece[1:] == piece[:-1]
    return together, (mix(h[:-1] * _STEP + h[1:]) >> np.uint64(64 - bits)).astype(np.int64)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, w (its hash) and n (occurrences); ``docs`` has text and lang."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in _groups(batches, GROUP_BYTES):
            h, _, which, span, joined = cut(texts, langs)
            found, first, n = np.unique(h, return_index=True, return_counts=True)
            lang = [langs[i] for i in which[first].tolist()]
            word = [joined[a:b].decode() for a, b in span[first].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), _signed(found), pa.array(n)],
                                             names=["lang", "word", "w", "n"])
    rows = docs.mapInArrow(count, "lang string, word string, w bigint, n bigint")
    return rows.groupBy("lang", "word", "w").agg(F.sum("n").alias("n"))


def counter_bits(words: int, most: int) -> int:
    """Bits of a table with eight counters for every ``most`` words: one that rare pairs share then seldom gets to ``most``."""
    return min(max(COUNTER_BITS, math.ceil(math.log2(max(8 * words / most, 1)))), MOST_COUNTER_BITS)


def pairs_often(docs: DataFrame, most: int, bits: int) -> np.ndarray:
    """For each of 2^``bits`` counters, a bit (packed): whether its word pairs occur ``most`` (at most 255) times or more.

    Tasks send their counters in slices, which are added up where the slice goes; the driver gets 2^``bits`` bits."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, np.uint8)
        for texts, langs in _groups(batches, GROUP_BYTES):
            h, piece, _, _, _ = cut(texts, langs)
            if len(h) > 1:
                together, at = _pairs(h, piece, bits)
                at, n = np.unique(at[together], return_counts=True)
                own[at] = np.minimum(own[at] + n, most)
        for i, part in enumerate(own.reshape(-1, 1 << SLICE_BITS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])],
                                                 names=["slice", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([zlib.compress(np.packbits(total >= most).tobytes(), 1)])], names=["slice", "part"])
        for b in batches:
            for i, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i != now:
                    if now is not None:
                        yield row()
                    now, total = i, np.zeros(1 << SLICE_BITS, np.uint32)
                total = np.minimum(total + np.frombuffer(zlib.decompress(part), np.uint8), most)
        if now is not None:
            yield row()

    slices = docs.mapInArrow(count, "slice int, part binary").repartition("slice").sortWithinPartitions("slice")
    out = np.zeros((1 << (bits - SLICE_BITS), (1 << SLICE_BITS) // 8), np.uint8)
    for r in slices.mapInArrow(add, "slice int, part binary").collect():
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["part"]), np.uint8)
    return out.ravel()


def suffixes(docs: DataFrame, min_count: int, words: int = 0) -> DataFrame:
    """w1 to w5 (0: the suffix is shorter) and n of every distinct suffix that starts with a pair not surely rare.

    ``words`` is the number of words of ``docs``, by which the pair counters are sized."""
    most = min(max(min_count, 1), 255)
    size = counter_bits(words, most)
    often = docs.sparkSession.sparkContext.broadcast(pairs_often(docs, most, size))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = often.value
        for texts, langs in _groups(batches, GROUP_BYTES):
            h, piece, _, _, _ = cut(texts, langs)
            if len(h) < 2:
                continue
            together, at = _pairs(h, piece, size)
            on = together & ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
            here = np.flatnonzero(on)
            on, words = np.concatenate([on, np.zeros(DEPTH, bool)]), np.concatenate([h, np.zeros(DEPTH, np.uint64)])
            rows, alive = [words[here]], np.ones(len(here), bool)
            for d in range(1, DEPTH):
                alive &= on[here + d - 1]
                rows.append(np.where(alive, words[here + d], np.uint64(0)))
            order = np.lexsort(rows[::-1])
            rows = [r[order] for r in rows]
            new = np.concatenate([[True], np.any([r[1:] != r[:-1] for r in rows], axis=0)]) if len(here) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(here)))
            for a in range(0, len(first), 50_000):
                part = first[a:a + 50_000]
                yield pa.RecordBatch.from_arrays([*(_signed(np.ascontiguousarray(r[part])) for r in rows), pa.array(n[a:a + 50_000])], names=[*W, "n"])

    found = docs.mapInArrow(emit, ", ".join(f"{w} bigint" for w in W) + ", n bigint")
    return found.groupBy(*W).agg(F.sum("n").alias("n"))


def _prefix(rows: list[np.ndarray], depth: int) -> np.ndarray:
    """Hash of the first ``depth`` words of each suffix."""
    h = np.full(len(rows[0]), depth, np.uint64)
    for r in rows[:depth]:
        h = mix(h * _STEP + r)
    return h


def _prefix_depth(rows: list[np.ndarray], split: list[np.ndarray]) -> np.ndarray:
    """Words of the prefix that each suffix is grouped by: one more than its longest split prefix."""
    depth = np.ones(len(rows[0]), np.int64)
    for d, heavy in enumerate(split, start=1):
        depth += (depth == d) & np.isin(_prefix(rows, d), heavy)
    return np.minimum(depth, DEPTH)


def frequent_nodes(found: DataFrame, min_count: int, budget: int = BUDGET) -> DataFrame:
    """w1 to w5 and f of every phrase of two or more words with f >= ``min_count`` in the suffixes (w1 to w5, n)."""
    total = found.count()
    budget = max(budget, total // MOST_GROUPS)
    groups = max(1, -(-2 * total // budget))
    split, above = [], []
    rows = found
    for d in range(1, DEPTH):
        heavy = rows.groupBy(*W[:d]).agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("f")) \
            .where(F.col("size") > budget // SHARE).select(*W[:d], "f").collect()
        if not heavy:
            break
        columns = [np.array([r[w] for r in heavy], np.int64).view(np.uint64) for w in W[:d]]
        split.append(np.sort(_prefix(columns, d)))
        above += [(*[r[w] for w in W[:d]], *[0] * (DEPTH - d), r["f"]) for r in heavy if d > 1]
        keys = found.sparkSession.createDataFrame([tuple(r[w] for w in W[:d]) for r in heavy], ", ".join(f"{w} bigint" for w in W[:d]))
        rows = rows.join(F.broadcast(keys), W[:d], "left_semi").where(F.col(W[d]) != 0)
    known = found.sparkSession.sparkContext.broadcast(split)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = [b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(DEPTH)]
            depth = _prefix_depth(r, known.value)
            group = np.zeros(len(depth), np.uint64)
            for d in range(1, DEPTH + 1):
                group = np.where(depth == d, _prefix(r, d), group)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((group % np.uint64(groups)).astype(np.int64))],
                                             names=[*W, "n", "part"])

    def subtree(t: pa.Table) -> pa.Table:
        r = [t.column(w).to_numpy().view(np.uint64) for w in W]
        order = np.lexsort(r[::-1])
        r, n = [x[order] for x in r], t.column("n").to_numpy()[order]
        prefix = _prefix_depth(r, known.value)
        run = np.zeros(len(n), bool)
        run[:1] = True
        out = [[] for _ in range(DEPTH + 1)]
        for d in range(1, DEPTH + 1):
            run[1:] |= r[d - 1][1:] != r[d - 1][:-1]
            if d == 1:
                continue
            first = np.flatnonzero(run)
            f = np.add.reduceat(n, first)
            keep = (f >= min_count) & (r[d - 1][first] != 0) & (prefix[first] <= d)
            at = first[keep]
            for i in range(DEPTH):
                out[i].append(r[i][at] if i < d else np.zeros(len(at), np.uint64))
            out[DEPTH].append(f[keep].astype(np.uint64))
        return pa.table([_signed(np.concatenate(x)) for x in out], names=[*W, "f"])

    schema = ", ".join(f"{w} bigint" for w in W)
    nodes = found.mapInArrow(deal, f"{schema}, n bigint, part bigint").groupBy("part").applyInArrow(subtree, f"{schema}, f bigint")
    more = found.sparkSession.createDataFrame(above, f"{schema}, f bigint").where(F.col("f") >= min_count)
    return nodes.unionByName(more)


def _part(first, size):
    """Struct of the ``size`` words from ``first`` (columns) of the array ``ws``, filled up with 0."""
    words = F.concat(F.slice("ws", first, size), F.array_repeat(F.lit(0).cast("long"), DEPTH - size))
    return [words.getItem(i).alias(w) for i, w in enumerate(W)]


def score_cuts(candidates: DataFrame, nodes: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, w1 to w5, m (words), a, l, r, n and score of each candidate: of its cuts the one with the least score.

    nodes and words (lang, w, n) count all parts of candidates; totals has the words (n) of each lang."""
    one = words.select(F.col("w").alias("w1"), *[F.lit(0).cast("long").alias(w) for w in W[1:]], F.col("n").alias("f"))
    parts = nodes.unionByName(one)
    size = F.size(F.filter(F.array(*W), lambda w: w != 0))
    cuts = candidates.select(*W, F.col("f").alias("a"), size.alias("m"), F.array(*W).alias("ws")) \
        .select("*", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select(*W, "a", "m", "k", F.struct(*_part(F.lit(1), F.col("k"))).alias("left"),
                       F.struct(*_part(F.col("k") + 1, F.col("m") - F.col("k"))).alias("right"))
    for side, total in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select(F.struct(*W).alias(side), F.col("f").alias(total)), side)
    lang = words.select(F.col("w").alias("w1"), "lang")
    exact = "CAST({} AS DECIMAL(20,0))"
    score = F.expr(f"(CAST(1000 AS DECIMAL(4,0)) * {exact.format('a')} * CAST(n AS DECIMAL(13,0))) div ({exact.format('l')} * CAST(r AS DECIMAL(18,0)))")
    best = cuts.join(lang, "w1").join(totals, "lang").withColumn("score", score).groupBy("lang", *W, "m", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", *W, "m", "a", "cut.l", "cut.r", "n", "cut.score")


def drop_contained(nodes: DataFrame) -> DataFrame:
    """``nodes`` (w1 to w5, f) without those that stand in a longer one that is as frequent."""
    size = F.size(F.filter(F.array(*W), lambda w: w != 0))
    inner = nodes.select("f", size.alias("m"), F.array(*W).alias("ws")).where("m > 2")
    spans = F.expr("filter(flatten(transform(sequence(2, m - 1), s -> transform(sequence(1, m - s + 1), p -> struct(p, s)))), "
                   "x -> x.s < m)")
    inner = inner.select("f", "ws", F.inline(spans)).withColumnsRenamed({"col1": "p", "col2": "s"})
    longer = inner.select(*_part(F.col("p"), F.col("s")), "f").groupBy(*W).agg(F.max("f").alias("_longer"))
    return nodes.join(longer, W, "left").where("_longer IS NULL OR _longer < f").drop("_longer")


def collocations(docs: DataFrame, min_count: int = 100, top: int = 2000, text: str = "text", lang: str = "lang",
                 budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by score, a (both descending), phrase.

    A phrase has 2 to 5 words of one piece and a >= ``min_count`` occurrences; see the module for what is counted, and
    :func:`score_cuts` and :func:`drop_contained` for scores and for phrases within longer ones. Null text is empty,
    null lang is ``und``; repeated rows count again, empty tables give no rows, other columns are not read. Products are
    decimals of 38 digits: more than 10^13 words of a language or 10^18 of a phrase raise an error, none wraps.
    """
    src = bounded(docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")))
    words = written(word_counts(src), "phrase-words")
    if words.groupBy("w").count().where("count > 1").limit(1).count():
        raise ValueError("two words have one hash; change the seed of the word hashes")
    found = written(suffixes(src, min_count, words.agg(F.sum("n")).first()[0] or 0), "phrase-suffixes")
    nodes = written(frequent_nodes(found, min_count, budget), "phrase-nodes")
    often = written(words.where(F.col("n") >= min_count), "phrase-often")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    kept = written(score_cuts(drop_contained(nodes), nodes, often, totals), "phrase-scores")
    spelled = kept.select(*W, F.posexplode(F.filter(F.array(*W), lambda w: w != 0)).alias("p", "w")) \
        .join(often.select("w", "word"), "w").groupBy(*W).agg(F.sort_array(F.collect_list(F.struct("p", "word"))).alias("s"))
    phrase = F.array_join(F.transform("s", lambda x: x["word"]), " ")
    ranked = kept.join(spelled.select(*W, phrase.alias("phrase")), W).select("lang", "phrase", "a", "l", "r", "n", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return ranked.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
