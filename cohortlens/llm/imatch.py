"""I-Match fingerprints: hashes of the sorted distinct mid-frequency terms over several randomised lexicons.

A term is kept if its inverse document frequency lies in a band, counted over all documents. The lexicon of band terms
has at most (mean distinct terms of a document) / (least document share) entries, whatever the size of the corpus;
that bound is checked before it is shipped to the tasks. A text has the hash of its sorted distinct terms in the whole
lexicon, and in randomised sub-lexicons: for each of several seeds, nested random samples that keep 1/2, 1/4, ... of
the terms. Two texts agree on a sub-lexicon where they have the same terms, so small samples still agree on texts that
share a part of their terms. The likeness of two fingerprints is the share of seeds whose smallest sample in which
either text has a term agrees; it estimates the share of their terms that two texts have in common.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.layout import MOST_COPIES, bounded, counted_copies, neighbour_ranges
from cohortlens.llm.words import cut, groups, mix

SEEDS = 16
LEVELS = 12
#: Texts with fewer band terms are hashed over all their terms instead.
LEAST_TERMS = 4
#: Largest lexicon that is shipped to the tasks (8 bytes a term).
LEXICON_BOUND = 4_000_000
#: Characters of a text that order equal keys.
LEAD = 64
_SEEDS = mix(np.arange(1, SEEDS + 1, dtype=np.uint64))[:, None]
#: A sample keeps the terms whose seeded draw is below its threshold.
_THRESHOLDS = [np.uint64(1 << (64 - level)) for level in range(1, LEVELS + 1)]


def _terms(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct term hashes of each text."""
    out: list[np.ndarray] = []
    for first, end in groups(texts):
        h, which, _, _ = cut(texts[first:end])
        ends = np.searchsorted(which, np.arange(end - first + 1))
        out += [np.unique(h[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    return out


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): in how many rows each term hash occurs; counted in each task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            t, i = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return t, np.bincount(i, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        parts, held = [], 0
        for b in batches:
            texts = [(t or "").encode() for t in b.column(0).to_pylist()]
            for first, end in groups(texts, 4 << 20):
                own = _terms(texts[first:end])
                t, n = np.unique(np.concatenate(own), return_counts=True)
                parts.append((t, n))
                held += len(t)
                if held > 2_000_000:  # bounds what a task holds: flush when merging no longer helps
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > 1_500_000:
                        yield _batch(*parts.pop())
                        held = 0
        if parts:
            yield _batch(*merged(parts))

    def _batch(t: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], names=["term", "df"])

    return bounded(docs.select(text)).mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def band_lexicon(docs: DataFrame, text: str = "text", least_share: float = 0.0005,
                 most_share: float = 0.15) -> np.ndarray:
    """Sorted hashes of the terms with log(1 / most_share) <= idf <= log(1 / least_share) over all ``docs``."""
    n = docs.select(F.count(F.lit(1)).alias("n")).first()["n"]
    kept = document_frequencies(docs, text).where(
        (F.col("df") >= F.lit(n * least_share)) & (F.col("df") <= F.lit(max(n * most_share, 1.0)))).select("term")
    rows = kept.limit(LEXICON_BOUND + 1).toArrow().column(0).to_numpy()
    if len(rows) > LEXICON_BOUND:
        raise ValueError(f"over {LEXICON_BOUND} terms in the band: raise least_share")
    return np.sort(rows.view(np.uint64))


def signature(terms: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Hashes (16 bits each): four of the whole lexicon, then SEEDS x LEVELS of the samples; 0 means no term."""
    out = np.zeros(4 + SEEDS * LEVELS, np.uint16)
    if len(lexicon) and len(terms):
        at = np.minimum(np.searchsorted(lexicon, terms), len(lexicon) - 1)
        band = terms[lexicon[at] == terms]
    else:
        band = terms[:0]
    kept = band if len(band) >= LEAST_TERMS else terms
    if not len(kept):
        return out
    digest = xxhash.xxh64_intdigest
    out[:4] = np.array([digest(kept.tobytes())], np.uint64).view(np.uint16)
    draws = np.sort(mix(kept[None, :] ^ _SEEDS), axis=1)  # a bijection of the terms for each seed, sorted
    data, wide = memoryview(draws).cast("B"), 8 * len(kept)
    for level, threshold in enumerate(_THRESHOLDS):
        sizes = (draws < threshold).sum(axis=1).tolist()
        for seed, n in enumerate(sizes):
            if n:
                out[4 + seed * LEVELS + level] = digest(data[seed * wide:seed * wide + 8 * n], level) % 0xFFFF + 1
        draws = draws[:, :max(sizes)] if max(sizes) else draws[:, :0]
        if not draws.shape[1]:
            break
    return out


def as_text(sign: np.ndarray) -> str:
    """A signature as hex digits, four for each hash."""
    return sign.astype(">u2").tobytes().hex()


def as_signature(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u2").astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of seeds that agree on the smallest sample in which either text has a term; 1 for equal signatures."""
    if np.array_equal(a, b):
        return 1.0
    x, y = a[4:].reshape(SEEDS, LEVELS), b[4:].reshape(SEEDS, LEVELS)
    some = (x | y) != 0
    used = some.any(axis=1)
    if not used.any():
        return 0.0
    last = LEVELS - 1 - np.argmax(some[:, ::-1], axis=1)
    seeds = np.arange(SEEDS)
    return float((x[seeds, last] == y[seeds, last])[used].mean())


def fingerprints(docs: DataFrame, lexicon: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) for each row of ``docs``; null and empty texts have the fingerprint of no term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = _terms([(t or "").encode() for t in b.column(1).to_pylist()])
            found = [as_text(signature(t, lexicon)) for t in terms]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["key", "fingerprint"])

    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return bounded(src).mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, fingerprint string") \
        .select(F.col("key").alias(key), "fingerprint")


def edited_text(own: str, following: str) -> str:
    """``own`` with its last floor(n/2) characters replaced by the first as many (or all) of ``following``."""
    half = len(own) // 2
    return own[:len(own) - half] + following[:half]


def fingerprint_edits(docs: DataFrame, lexicon: np.ndarray, ranges: int, key: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """Fingerprint of each text, of its edited text, and their likeness, and that to the next document.

    The next document is the next by ascending key (null first; equal keys by the first LEAD characters of their texts,
    then by a hash of the whole text), and the first one behind the last. Null is the empty text. Texts move once,
    compressed. Repeated rows all stay: of n equal rows, n - 1 are followed by an equal one, and a task sends those it
    holds as one row for each MOST_COPIES, dealt apart from the order. An empty table gives no rows; other columns are
    not read. Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    src = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        "key", F.substring("text", 1, LEAD).alias("lead"), F.xxhash64("text").alias("h"), "text")
    kind = src.schema["key"].dataType.simpleString()

    def pack(d: DataFrame) -> DataFrame:
        return bounded(d).mapInArrow(lambda batches: counted_copies(batches, MOST_COPIES),
                                     f"key {kind}, lead string, h bigint, data binary, copies bigint, spread int")

    # a boundary is one text, and equal keys spread over ranges by their texts
    dealt = neighbour_ranges(src, ["key", "lead", "h"], ranges, pack, "spread")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            columns = (b.column(n).to_pylist() for n in ("key", "data", "_range", "_role", "copies"))
            for k, data, r, role, copies in zip(*columns, strict=True):
                yield r, role, k, zlib.decompress(data), copies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        before = None  # (range, key, text, fingerprint), waiting for its next document
        for r, role, k, data, copies in rows(batches):
            if role < 0:
                continue
            if role == 3:  # rows that are followed by an equal one
                t = data.decode()
                edited = edited_text(t, t).encode()
                fp, edited_fp = (signature(x, lexicon) for x in _terms([data, edited]))
                out += [(k, len(t), hashlib.sha256(edited).hexdigest(), as_text(fp), as_text(edited_fp),
                         likeness(fp, edited_fp), 1.0)] * copies
                size += copies
                if size >= 2000:
                    yield _out(out)
                    out, size = [], 0
                continue
            waits = before is not None and before[0] == r
            if role > 0 and not waits:
                continue
            t = data.decode()
            if waits:
                edited = edited_text(before[2], t).encode()
                own_terms, edited_terms = _terms([data, edited])
                fp, edited_fp = signature(own_terms, lexicon), signature(edited_terms, lexicon)
                out.append((before[1], len(before[2]), hashlib.sha256(edited).hexdigest(), as_text(before[3]),
                            as_text(edited_fp), likeness(before[3], edited_fp), likeness(before[3], fp)))
                size += 1
            elif role == 0:
                fp = signature(_terms([data])[0], lexicon)
            before = (r, k, t, fp) if role == 0 else None
            if size >= 2000:
                yield _out(out)
                out, size = [], 0
        if out:
            yield _out(out)

    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def _out(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*found, strict=True)), strict=True)),
                                          schema=pa.schema([("key", key_type), ("n_chars", pa.int64())]
                                                           + [(n, pa.string()) for n in names[2:5]]
                                                           + [(n, pa.float64()) for n in names[5:]]))

    key_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return dealt.mapInArrow(run, f"key {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double") \
        .withColumnRenamed("key", key)
