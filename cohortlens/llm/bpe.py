"""Byte-level BPE of whole texts through a table of distinct words; ids back to text through an id-to-piece join.

1. Texts are split into the tokenizer's words in the scan. A block (the texts of a task, up to BLOCK_CHARS) holds the
   number of the word at each position, and its distinct words. Blocks are written once to the shared folder.
2. The distinct words go to the buckets of their hash, a packed list for each block and bucket. A bucket is the part
   of the distinct-word table: each word is encoded once by the library, whatever the number of blocks that hold it, and
   its ids are sent back to the blocks.
3. In a block, ids meet their pieces (the id-to-piece table has a row for each id of the vocabulary, so that join is
   map-side), and ids and pieces of words are joined to the positions by word number.

Why words can be encoded alone: merges never cross the words of the pre-tokenizer, and a word cut from a text is cut the
same way when it stands alone. Special strings are cut out first, as the library does, and are words of their own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.layout import bounded
from cohortlens.llm.shared import bucketed
from cohortlens.llm.token_count import load

#: Characters of a block, unless one text is longer; and of a packed row of texts.
BLOCK_CHARS, PART_CHARS = 32_000_000, 1_000_000
#: Distinct words that a bucket remembers with their ids; beyond, it starts anew (a memory bound, same results).
MEMO = 400_000
#: Fixed value: how byte-level BPE splits text.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters only are split by WORD here; others by the library, whose Unicode tables may be newer.
PLAIN = r"[\x00-\x1B\x20-ɏ‐-‧‰-⁞]*+"


@lru_cache(maxsize=2)
def special_strings(path: str) -> list[str]:
    """The strings that the tokenizer takes out of a text before it splits it into words."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get(
            "use_regex", True) or (spec.get("decoder") or {}).get("type") != "ByteLevel" or any(
            a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added):
        raise ValueError(f"{path} is no plain byte-level tokenizer")
    return [a["content"] for a in added]


class Splitter:
    """Cuts a text into the tokenizer's words."""

    def __init__(self, path: str):
        own = sorted(special_strings(path), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, own)) + ")") if own else None
        self.word, self.plain, self.library = regex.compile(WORD), regex.compile(PLAIN), load(path).pre_tokenizer

    def _cut(self, text: str) -> list[str]:
        if self.plain.fullmatch(text):
            return self.word.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def __call__(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self._cut(text)
        parts = self.special.split(text)
        return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self._cut(p))]


@lru_cache(maxsize=2)
def piece_table(path: str) -> list[bytes]:
    """The bytes of each id. Fixed by byte-level BPE: printable characters stand for their own byte, the other bytes
    for the characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in own}
    byte.update((chr(0x100 + i), b) for i, b in enumerate(b for b in range(256) if b not in set(own)))
    t = load(path)
    vocab = {i: p for p, i in t.get_vocab(with_added_tokens=True).items()}
    return [bytes(byte[c] for c in p) if all(c in byte for c in p) else p.encode()
            for p in (vocab.get(i, "") for i in range(max(vocab) + 1))]


def _pack(parts: list[bytes]) -> bytes:
    """Byte strings in one compressed one: lengths, then all of them."""
    size = np.fromiter(map(len, parts), np.uint32, len(parts))
    return zlib.compress(np.uint32(len(parts)).tobytes() + size.tobytes() + b"".join(parts), 1)


def _unpack(data: bytes) -> list[bytes]:
    data = zlib.decompress(data)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    at = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64)]) + 4 + 4 * n
    edge = at.tolist()
    return [data[a:b] for a, b in zip(edge, edge[1:], strict=False)]


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def blocks(docs: DataFrame, path: str, key: str, text: str, buckets: int) -> DataFrame:
    """block, then for each row of texts keys, sizes (their words) and seq (word numbers), and for each bucket of a
    block bucket, words and numbers; the columns of the other kind are null."""
    kind = docs.select(key).schema[0].dataType
    schema = f"block bigint, keys array<{kind.simpleString()}>, sizes binary, seq binary, bucket int, words binary, numbers binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(path)
        number, names = TaskContext.get().partitionId() << 32, schema
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # keys, words of each text, word at each position
        seen: dict[str, int] = {}
        chars, arrow = 0, None

        def out(columns: dict) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n)).cast(f.type) for f in arrow], schema=arrow)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, chars
            count = np.zeros(len(seen), np.int64)
            for _, _, seq in held:
                count += np.bincount(seq, minlength=len(seen))
            by_use = np.argsort(-count, kind="stable")
            rank = np.empty(len(seen), np.uint32)
            rank[by_use] = np.arange(len(seen))
            for keys, sizes, seq in held:
                yield out({"block": pa.array([number]), "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                           "sizes": pa.array([zlib.compress(sizes.tobytes(), 1)]), "seq": pa.array([_planes(rank[seq])])})
            words = [w.encode() for w in seen]
            own = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(own, kind="stable")
            edges = np.flatnonzero(np.diff(np.concatenate([[-1], own[order], [-1]])))
            for a, b in zip(edges, edges[1:], strict=False):
                mine = sorted(order[a:b].tolist(), key=words.__getitem__)
                yield out({"block": pa.array([number]), "bucket": pa.array([int(own[order[a]])]),
                           "words": pa.array([_pack([words[i] for i in mine])]), "numbers": pa.array([_planes(rank[mine])])})
            number, chars = number + 1, 0
            held.clear()
            seen.clear()

        for b in batches:
            if arrow is None:
                arrow = pa.schema([("block", pa.int64()), ("keys", pa.list_(b.schema.field(0).type)), ("sizes", pa.binary()),
                                   ("seq", pa.binary()), ("bucket", pa.int32()), ("words", pa.binary()), ("numbers", pa.binary())])
            texts, first, size, seq, sizes = b.column(1).to_pylist(), 0, 0, [], []
            for i, t in enumerate(texts):
                found = split(t or "")
                seq += [seen.setdefault(w, len(seen)) for w in found]
                sizes.append(len(found))
                size += len(t or "")
                if size >= PART_CHARS or i + 1 == len(texts):
                    held.append((b.column(0).slice(first, i + 1 - first), np.array(sizes, np.int64), np.array(seq, np.int64).astype(np.uint32)))
                    chars += size
                    first, size, seq, sizes = i + 1, 0, [], []
                    if chars >= BLOCK_CHARS:
                        yield from flush()
        if held:
            yield from flush()

    return bounded(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(cut, schema)


def encode_words(lists: DataFrame, path: str, partitions: int) -> DataFrame:
    """block, numbers, counts and ids (all ids of its words, one after the other) of every word list (block, bucket, words, numbers).

    Lists of a bucket meet in one task, which encodes each distinct word once."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        memo: dict[bytes, list[int]] = {}
        for b in batches:
            for i in range(b.num_rows):
                words = _unpack(b.column(2)[i].as_py())
                new = [w for w in words if w not in memo]
                if len(memo) + len(new) > MEMO:
                    memo.clear()
                    new = words
                for first in range(0, len(new), 4096):
                    part = new[first:first + 4096]
                    found = tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
                    memo.update((w, e.ids) for w, e in zip(part, found, strict=True))
                own = [memo[w] for w in words]
                counts = np.fromiter(map(len, own), np.uint32, len(own))
                ids = np.fromiter((x for word in own for x in word), np.uint32, int(counts.sum()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1), b.column(3).slice(i, 1), pa.array([_planes(counts)], pa.binary()),
                     pa.array([_planes(ids)], pa.binary())], names=["block", "numbers", "counts", "ids"])

    dealt = lists.select("block", "bucket", "words", "numbers").repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(encode, "block bigint, numbers binary, counts binary, ids binary")


def encode_and_decode(docs: DataFrame, path: str, partitions: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (decimal, comma-joined) as ids_sha256, and the text that the ids decode to as decoded_sha256.

    ids are those of the library for ``path`` without added special tokens, special strings in texts handled as its
    default; the decoded text is that of its decode without skipping any. Null is the empty text (no ids). Repeated
    rows are all kept, keys need not be unique, an empty table gives no rows, other columns are not read. A task
    holds the words and positions of one block, or MEMO words of a bucket; a text is one row, however long.

    Blocks are a bucketed table, so that only words and their ids are shuffled and the positions stay where they are.
    """
    special_strings(path)
    found = bucketed(blocks(docs, path, key, text, partitions), "bpe_blocks", partitions, "block")
    back = encode_words(found.where("bucket IS NOT NULL"), path, partitions)
    places = found.where("bucket IS NULL").select("block", "keys", "sizes", "seq")
    kind = places.schema["keys"].dataType.elementType.simpleString()

    def join(texts: pa.Table, words: pa.Table) -> pa.Table:
        pieces = piece_table(path)
        name = list(map(str, range(len(pieces))))
        lists = [tuple(_numbers(c.as_py()) for c in row) for row in zip(*words.select(["numbers", "counts", "ids"]).columns, strict=True)]
        n = sum(len(x[0]) for x in lists)
        as_ids, as_text, count = [b""] * n, [b""] * n, np.zeros(n, np.int64)
        for place, counts, ids in lists:
            count[place] = counts
            own, end = ids.tolist(), np.cumsum(counts).tolist()
            for j, a, b in zip(place.tolist(), [0, *end], end):
                mine = own[a:b]
                as_ids[j] = ",".join([name[x] for x in mine]).encode()
                as_text[j] = b"".join([pieces[x] for x in mine])
        keys, n_tokens, ids_sha, text_sha = [], [], [], []
        for own_keys, sizes, seq in zip(*texts.select(["keys", "sizes", "seq"]).columns, strict=True):
            keys.append(own_keys.values)
            place, at = _numbers(seq.as_py()), 0
            for size in np.frombuffer(zlib.decompress(sizes.as_py()), np.int64).tolist():
                mine = place[at:at + size]
                at += size
                n_tokens.append(int(count[mine].sum()))
                mine = mine.tolist()
                ids_sha.append(hashlib.sha256(b",".join([as_ids[x] for x in mine])).hexdigest())
                decoded = b"".join([as_text[x] for x in mine]).decode("utf-8", "replace")
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
        return pa.table([pa.chunked_array(keys, texts.schema.field("keys").type.value_type), pa.array(n_tokens, pa.int64()),
                         pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                        names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    met = places.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        join, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return met.withColumnRenamed("key", key)


def decode(ids: DataFrame, path: str, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """key and ``decoded`` (text) of rows of ids (an array; null: no ids), joined to the id-to-piece table by id.

    The key should be unique: rows of equal keys and places would mix. An id that is no id of the vocabulary is skipped."""
    table = ids.sparkSession.createDataFrame(list(enumerate(map(bytearray, piece_table(path)))), "id int, piece binary")
    rows = ids.select(F.col(key).alias("key"), F.posexplode_outer(column).alias("place", "id"))
    found = rows.join(F.broadcast(table), "id", "left").groupBy("key").agg(
        F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("place", F.hex("piece").alias("piece"))))).alias("p"))
    data = F.unhex(F.array_join(F.transform("p", lambda x: x["piece"]), ""))

    @F.arrow_udf("string")
    def as_text(data: pa.Array) -> pa.Array:
        return pa.array([(d or b"").decode("utf-8", "replace") for d in data.to_pylist()], pa.string())

    return found.select(F.col("key").alias(key), as_text(data).alias("decoded"))
