"""SimHash near-duplicates: fingerprints, a pigeonring join on distinct fingerprints, connected components.

Fingerprint: 64 bits; bit i is set if it is set in over half of the XXH64 hashes (seed 42) of all word shingles.

Pigeonring: cut the 64 bits into m = bits + 1 segments on a ring. If two fingerprints differ in at most ``bits``
bits, some segment starts a chain whose first l segments together differ in at most l * bits / m bits, for every l.
So the first segment is equal and the second has at most one difference, hence one of its halves is equal: those two
parts are the index key. Pairs that share a key are pruned by the budgets of longer and longer chains before the full
Hamming check (the chain of all m segments).

Work at scale: copies collapse before the join (distinct fingerprints). A key shared by more than ``block`` of them is
split into blocks, and each pair of blocks is a group of its own, so no task holds more than two blocks for a
group, and no pair is lost. A group gives back a star for each of its components, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.llm.components import connected_components
from cohortlens.llm.layout import bounded, cut_lineage

SEED = 42
#: Shingles whose bits are counted at a time.
PIECE = 1 << 15


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned fingerprint of one text; 0 without words; a text of fewer words is one shingle."""
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    data = b" ".join(own)
    size = np.fromiter(map(len, own), np.int64, len(own))
    start = np.cumsum(size + 1) - size - 1
    k = min(words, len(own))
    first, end = start[:len(own) - k + 1].tolist(), (start + size)[k - 1:].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(first), PIECE):
        h = np.array([digest(data[x:y], SEED) for x, y in zip(first[a:a + PIECE], end[a:a + PIECE], strict=True)],
                     dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(first), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, own, fp) for each row; ``fp`` is the fingerprint as a signed long, ``own`` a hash of the text.

    Null and empty texts have fingerprint 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, words) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int64())],
                                             names=["key", "own", "fp"])

    src = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("own"), F.col(text).alias("text"))
    return bounded(src).mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, own bigint, fp bigint")


def segments(bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the bits + 1 segments."""
    m = bits + 1
    wide = 64 % m
    width = [64 // m + (i < wide) for i in range(m)]
    low = np.cumsum([0, *width]).tolist()
    return list(zip(low, width, strict=False))


def _mask(parts: list[tuple[int, int]]) -> int:
    return sum(((1 << w) - 1) << low for low, w in parts)


def _keys(bits: int) -> list[tuple[int, int]]:
    """(chain start, mask of the bits that the key holds); two for each start."""
    seg, out = segments(bits), []
    for i, own in enumerate(seg):
        low, w = seg[(i + 1) % len(seg)]
        out += [(i, _mask([own, half])) for half in ((low, w // 2), (low + w // 2, w - w // 2))]
    return out


def _chains(bits: int) -> np.ndarray:
    """[start, l]: mask of the first l + 1 segments from ``start``, whose budget is (l + 1) * bits // m."""
    seg = segments(bits)
    m = len(seg)
    return np.array([[_mask([seg[(i + j) % m] for j in range(n + 1)]) for n in range(m)] for i in range(m)], np.uint64)


def _within(x: np.ndarray, chain: np.ndarray, bits: int) -> np.ndarray:
    """Which differences ``x`` pass every budget of their chains; the last is the full Hamming check."""
    alive = np.arange(len(x))
    m = chain.shape[-1]
    for n in range(m):
        mask = chain[n] if chain.ndim == 1 else chain[alive, n]
        alive = alive[np.bitwise_count(x[alive] & mask) <= (n + 1) * bits // m]
    return alive


def _roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest member of each node's component, given the links a - b of n nodes."""
    label = np.arange(n) if label is None else label
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def group_links(start: np.ndarray, size: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (member, root) of the groups of one batch.

    ``fps``: all fingerprints, group after group, sorted within each; ``size`` and ``start``: of each group its number
    of members and the chain start of its key.
    """
    chains = _chains(bits)
    n = len(fps)
    group = np.repeat(np.arange(len(size)), size)
    place = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    left = np.repeat(size, size) - place  # members from here to the end of the group
    label = np.arange(n)
    found_a: list[np.ndarray] = []
    found_b: list[np.ndarray] = []
    held = 0
    step = 1
    while len(at := np.flatnonzero(left > step)):
        for first in range(0, len(at), 1 << 20):
            a = at[first:first + (1 << 20)]
            ok = _within(fps[a] ^ fps[a + step], chains[start[group[a]]], bits)
            found_a.append(a[ok])
            found_b.append(a[ok] + step)
            held += len(ok)
            if held > 1 << 21:
                label = _roots(n, np.concatenate(found_a), np.concatenate(found_b), label)
                star = np.flatnonzero(label != np.arange(n))
                found_a, found_b, held = [star], [label[star]], 0
        step += 1
    if found_a:
        label = _roots(n, np.concatenate(found_a), np.concatenate(found_b), label)
    member = np.flatnonzero(label != np.arange(n))
    return fps[member], fps[label[member]]


def link_fingerprints(distinct: DataFrame, bits: int = 4, block: int = 2048) -> DataFrame:
    """Links (a, b) that connect every two fingerprints ``fp`` within ``bits`` bits, directly or through others."""
    if bits < 1:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    if bits > 20:
        raise ValueError("keys of so many segments are too short")
    signed = [m - (1 << 64) if m >> 63 else m for _, m in _keys(bits)]
    key = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v"))
                    for i, m in enumerate(signed)])
    keyed = distinct.select("fp", F.explode(key).alias("key")).select("fp", "key.k", "key.v")
    sizes = keyed.groupBy("k", "v").count().where("count > 1").withColumn(
        "blocks", F.ceil(F.col("count") / block).cast("int")).select("k", "v", "blocks")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = keyed.join(sizes, ["k", "v"]).withColumn("own", own).withColumn("other", other)
    groups = dealt.groupBy("k", "v", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")) \
        .agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = np.diff(lists.offsets.to_numpy())
            fps = lists.flatten().to_numpy().view(np.uint64)
            start = b.column(0).to_numpy() // 2
            member, root = group_links(start, size, fps, bits)
            yield pa.RecordBatch.from_arrays([pa.array(member.view(np.int64)), pa.array(root.view(np.int64))],
                                             names=["a", "b"])

    return groups.select("k", "fps").mapInArrow(run, "a bigint, b bigint").distinct()


def _components(docs: DataFrame, words: int, bits: int, key: str, text: str, block: int) -> DataFrame:
    """(key, own, fp, root, component_id) for each row; root names the component."""
    fps = cut_lineage(fingerprints(docs, words, key, text))
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("key").alias("low")))
    roots = connected_components(link_fingerprints(distinct, bits, block))
    known = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    component = known.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(known.join(component, "root").select("fp", "root", "component_id"), "fp")


def simhash_components(docs: DataFrame, words: int = 4, bits: int = 4, key: str = "doc_id", text: str = "text",
                       block: int = 2048) -> DataFrame:
    """(key, fp, component_id) for each row; component_id is the smallest key reachable over links of ``bits`` bits.

    Equal fingerprints are linked (also those of texts without words, which are 0). A null key is not a candidate for
    component_id; a component of null keys alone has null. Repeated rows stay, each with its component. An empty
    table gives no rows. Columns other than the two named are not read.
    """
    return _components(docs, words, bits, key, text, block).select(F.col("key").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 4, bits: int = 4, key: str = "doc_id", text: str = "text",
             block: int = 2048) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest key (null keys last).

    Of several rows with that key, the one with the smallest text hash stays, once. All columns of ``docs`` are
    returned as they are.
    """
    chosen = _components(docs, words, bits, key, text, block).groupBy("root").agg(
        F.min(F.struct(F.col("key").isNull().alias("last"), "key", "own")).alias("c")) \
        .select(F.col("c.key").alias("_key"), F.col("c.own").alias("_chosen")).distinct()
    tagged = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.xxhash64(text).alias("o"))
    w = Window.partitionBy("k", "o").orderBy(F.xxhash64("row"))
    return tagged.join(chosen, F.col("k").eqNullSafe(F.col("_key")) & (F.col("o") == F.col("_chosen"))) \
        .withColumn("n", F.row_number().over(w)).where("n = 1").select("row.*")
