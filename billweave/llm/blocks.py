"""Blocks of documents and sorted 64-bit keys packed for a shuffle.

Where every word or line gives keys to count, a row per key is too much. A block of documents sends its sorted distinct keys, cut
by their high bits, so that a row is one (block, key range) and a task counts one key range.
"""

import struct

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.shared import let_go, small_batches, written

BLOCK_BYTES = 8 << 20
BLOCKS = "block long, doc_ids array<string>, sizes array<long>, n_words long, payload binary"


def blocked(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, text) as written blocks of whole documents; `payload` is their compressed text, `sizes` its cuts.

    Ids travel as text: beside a null, pandas would turn whole numbers into doubles and round those above 2^53.
    """
    small_batches(rows.sparkSession)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))

    def run(batches):
        let_go()
        squeeze = zstandard.ZstdCompressor(level=6).compress
        part, count = TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0

        def closed():
            sizes, words = [len(t) for t in texts], sum(len(t.split()) for t in texts)
            row = {"block": (part << 32) + count, "doc_ids": ids, "sizes": sizes, "n_words": words, "payload": squeeze(b"".join(texts))}
            return pd.DataFrame({name: [value] for name, value in row.items()})

        for frame in batches:
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                ids.append(doc_id)
                texts.append(text.encode())
                held += len(texts[-1])
                if held >= block_bytes:
                    yield closed()
                    ids, texts, held, count = [], [], 0, count + 1
        if ids:
            yield closed()

    return written(rows.mapInPandas(run, BLOCKS))


def texts_of(payload: bytes, sizes) -> list[bytes]:
    whole = zstandard.ZstdDecompressor().decompress(payload)
    ends = np.cumsum(np.asarray(sizes, np.int64))
    return [whole[e - s : e] for s, e in zip(sizes, ends)]


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers, best with many leading zeros: bytes of equal weight side by side, compressed."""
    raw = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return struct.pack("<Q", len(numbers)) + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(packed: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<Q", packed)
    raw = zstandard.ZstdDecompressor().decompress(packed[8:])
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").reshape(n).astype(np.uint64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their distances, in half a bit more than their entropy if they are hashes: a distance's upper part is as many zeros and
    a one, its lower part, about as wide as the mean distance, has whole bytes and the bits that are left."""
    first = int(keys[0]) if len(keys) else 0
    steps = np.diff(keys, prepend=keys[:1])
    joint = int(np.bitwise_or.reduce(steps))
    shift = max(0, (joint & -joint).bit_length() - 1)  # low bits that no distance has
    steps = steps >> np.uint64(shift)
    mean = (int(keys[-1]) - first >> shift) // len(keys) if len(keys) else 0
    width = max(0, mean.bit_length() - 1)
    whole, rest = divmod(width, 8)
    ends = np.cumsum((steps >> np.uint64(width)).astype(np.int64) + 1)
    upper = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    upper[ends - 1] = 1
    parts = steps.astype("<u8").view(np.uint8).reshape(-1, 8)
    left = np.unpackbits(parts[:, whole : whole + 1], axis=1)[:, 8 - rest :] if rest else np.zeros(0, np.uint8)
    head = struct.pack("<QQBB", len(keys), first, shift, width)
    return head + parts[:, :whole].tobytes() + np.packbits(left).tobytes() + np.packbits(upper).tobytes()


def unpack_keys(packed: bytes) -> np.ndarray:
    n, first, shift, width = struct.unpack_from("<QQBB", packed)
    whole, rest = divmod(width, 8)
    raw = np.frombuffer(packed, np.uint8, offset=18)
    parts = np.zeros((n, 8), np.uint8)
    parts[:, :whole] = raw[: n * whole].reshape(n, whole)
    raw = raw[n * whole :]
    used = -(-n * rest // 8)
    if rest:
        parts[:, whole] = np.packbits(np.unpackbits(raw[:used], count=n * rest).reshape(n, rest), axis=1)[:, 0] >> (8 - rest)
    upper = np.diff(np.flatnonzero(np.unpackbits(raw[used:])), prepend=-1).astype(np.uint64) - np.uint64(1)
    steps = parts.view("<u8").reshape(n).astype(np.uint64) | upper << np.uint64(width)
    return np.cumsum(steps << np.uint64(shift), dtype=np.uint64) + np.uint64(first)


def pack_counts(counts: np.ndarray, usual: int) -> bytes:
    """Whole numbers most of which are `usual`: the places of the others, then these."""
    other = np.flatnonzero(counts != usual)
    places = pack_keys(other.astype(np.uint64))
    return struct.pack("<QQ", len(counts), len(places)) + places + (pack(counts[other]) if len(other) else b"")


def unpack_counts(packed: bytes, usual: int) -> np.ndarray:
    n, size = struct.unpack_from("<QQ", packed)
    counts = np.full(n, usual, np.uint64)
    if len(packed) > 16 + size:
        counts[unpack_keys(packed[16 : 16 + size]).astype(np.int64)] = unpack(packed[16 + size :])
    return counts


def ranges_of(keys: np.ndarray, bits: int):
    """(range, from, to) of ascending keys cut by their highest `bits` bits."""
    if not bits:
        return [(0, 0, len(keys))]
    owner = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    return [(int(owner[a]), int(a), int(b)) for a, b in zip(cuts, np.append(cuts[1:], len(keys)))]


def range_bits(n_keys: int, keys_per_range: int = 1 << 21) -> int:
    """Bits of the range number, so that a range holds few enough keys for one task at any size of the input."""
    return max(0, int(np.ceil(np.log2(max(1, n_keys) / keys_per_range))))


def with_answers(blocks: DataFrame, answers: DataFrame, name: str = "answers") -> DataFrame:
    """`blocks` with the packed answers (block, range, packed) of their key ranges, ordered by range."""
    gathered = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "packed"))).alias(name))
    return blocks.join(gathered, "block", "left")
