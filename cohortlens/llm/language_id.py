"""Language identification by nearest centroid over TF-IDF vectors of character n-grams.

A text becomes counts of hashed byte trigrams of its letters (lower-cased; runs of anything else are one blank).
Counts are damped (1 + log), weighted by inverse document frequency and normalised to length 1. Each language has
several centroids (spherical k-means over a bounded sample of its labelled texts). The language of a text is that
of the centroid with the largest cosine; a text farther from it than the fitted distance for its length is rejected.

Fitting: a bounded sample (``per_language`` texts of each label, those with the smallest hash of the text) goes to
the driver as sparse vectors. Prediction: one narrow pass over the texts, whole texts, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.llm.layout import bounded, row_schema, wrapped

#: Hash bits of a trigram; the vectors have 2**BITS places.
BITS = 13
DIM = 1 << BITS
UNDETERMINED = "und"
#: Bytes of one text that are counted at a time.
PIECE = 1 << 20
#: Languages that a model may have; and how many times the sample a language's share of hashes holds.
MOST_LANGUAGES, SPARE = 10_000, 3
#: Length class from which a distance is fitted, and the share of the sample that may be farther than it allows for.
LONG_CLASS, FAR_SHARE = 3, 0.01
#: Least accepted cosine of the shorter classes (under 16, 64 and 256 n-grams), which prove little: random letters of
#: such a length reach about as much.
SHORT_REACH = (0.02, 0.02, 0.055)
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII: upper to lower case, all that is no letter to a blank; bytes of other characters stay.
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Model:
    """Fitted centroids. ``reach``: the least accepted cosine by centroid language and length class."""

    langs: list[str]
    idf: np.ndarray  # (DIM,)
    centroids: np.ndarray  # (DIM, centroids)
    owner: np.ndarray  # language index of each centroid
    reach: np.ndarray  # (languages, length classes)


def length_class(n_grams: np.ndarray) -> np.ndarray:
    """0 for under 16 n-grams, then one class for each power of four, 5 at most."""
    return np.clip(np.log2(np.maximum(n_grams, 1) / 4).astype(int) // 2, 0, 5)


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams of the whole text; memory does not grow with its length beyond the bytes."""
    data = b" " + b" ".join(text.lower().encode().translate(_FOLD).split()) + b" "
    out = np.zeros(DIM, np.int64)
    for first in range(0, max(len(data) - 2, 0), PIECE):
        a = np.frombuffer(data[first:first + PIECE + 2], np.uint8).astype(np.uint32)
        h = (a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA6B) + a[2:] * np.uint32(0xC2B2AE35))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out += np.bincount(h >> np.uint32(32 - BITS), minlength=DIM)
    return out


def _damped(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = [gram_counts(t) for t in b.column("text").to_pylist()]
        where = [np.flatnonzero(c) for c in counts]
        yield pa.RecordBatch.from_pydict({
            "lang": b.column("lang"), "place": pa.array([w.tolist() for w in where], pa.list_(pa.int32())),
            "n": pa.array([c[w].tolist() for c, w in zip(counts, where, strict=True)], pa.list_(pa.int64()))})


def _kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; starts from texts spread by farthest-first choice, so it is deterministic."""
    chosen = [0]
    best = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = _unit(np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
    return c


def fit(labelled: DataFrame, per_language: int = 400, centroids: int = 4, rounds: int = 8,
        slack: float = 0.6) -> Model:
    """Fit on ``labelled`` (text, lang; rows with a null in either are left out).

    ``per_language`` bounds the sample. ``slack``: a text of 256 n-grams or more is rejected if its cosine is under
    this share of what all but FAR_SHARE of the language's sample texts of such a length reach, so single odd or wrongly
    labelled texts do not move the bound; a shorter text is rejected under SHORT_REACH, or under that bound if it is
    less. No usable row gives a model without languages, which predicts ``und``.
    """
    x = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    # copies do not count: the sample is of distinct texts, so its limit follows from their number
    counts = x.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").count() \
        .limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    # hashes below a language's limit hold about SPARE times its sample, whatever the number of its distinct texts
    limits = [(r["lang"], min((1 << 63) - 1, -(1 << 63) + SPARE * per_language * (1 << 64) // r["count"])) for r in counts]
    table = x.sparkSession.createDataFrame(limits, "lang string, most bigint")
    slim = x.select("lang", F.xxhash64("text").alias("h")).join(F.broadcast(table), "lang") \
        .where(F.col("h") <= F.col("most")).select("lang", "h").distinct()
    w = Window.partitionBy("lang").orderBy("h")
    chosen = slim.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_language).select("lang", "h")
    rows = bounded(x).withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "h"], "left_semi") \
        .dropDuplicates(["lang", "h"]).select("text", "lang") \
        .mapInArrow(_sparse, "lang string, place array<int>, n array<bigint>").collect()
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return Model([], np.ones(DIM, np.float32), np.zeros((DIM, 0), np.float32), np.zeros(0, int), np.zeros((0, 6)))
    rows.sort(key=lambda r: (r["lang"], r["place"], r["n"]))
    df = np.zeros(DIM)
    for r in rows:
        df[r["place"]] += 1
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
    parts, owner, reach = [], [], np.full((len(langs), 6), np.inf)
    for i, lang in enumerate(langs):
        own = [r for r in rows if r["lang"] == lang]
        m = np.zeros((len(own), DIM), np.float32)
        for j, r in enumerate(own):
            m[j, r["place"]] = _damped(np.asarray(r["n"]))
        m = _unit(m * idf)
        c = _kmeans(m, centroids, rounds)
        near, size = (m @ c.T).max(axis=1), length_class(np.array([sum(r["n"]) for r in own]))
        far = near[size >= LONG_CLASS]
        bound = slack * float(np.quantile(far, FAR_SHARE)) if len(far) else SHORT_REACH[-1]
        reach[i] = bound
        reach[i, :LONG_CLASS] = np.minimum(SHORT_REACH, bound)
        parts.append(c)
        owner += [i] * len(c)
    return Model(langs, idf, np.concatenate(parts).T.astype(np.float32), np.array(owner), reach)


def predict_texts(model: Model, texts: list[str | None], block: int = 64) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and whether it is rejected, for each text."""
    lang, score, out = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
    use = [i for i, t in enumerate(texts) if t and model.langs and _LETTER.search(t)]
    for first in range(0, len(use), block):
        own = use[first:first + block]
        counts = np.stack([gram_counts(texts[i]) for i in own])
        cosine = _unit(_damped(counts) * model.idf) @ model.centroids
        best = np.argmax(cosine, axis=1)
        size = length_class(counts.sum(axis=1))
        for j, i in enumerate(own):
            own_lang = model.owner[best[j]]
            s = float(min(max(cosine[j, best[j]], 0.0), 1.0))
            lang[i], score[i] = model.langs[own_lang], s
            out[i] = bool(s < model.reach[own_lang, size[j]])
    return lang, score, out


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    A null text, or one without a letter, is ``und`` with score 0, rejected. Ties go to the first centroid. Repeated
    rows are predicted alike; extra columns of any name pass through inside ``row``; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = predict_texts(model, b.column(0).field(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()),
                 pa.array(found[2], pa.bool_())], names=["row", "lang_pred", "score", "rejected"])

    return wrapped(docs).mapInArrow(run, row_schema(docs, "lang_pred string, score double, rejected boolean"))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32(doc_id as text) mod 3 is 1 (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
