"""Static range asymmetric numeral system over token ids, in interleaved lanes.

A table gives every token a share of 2^`PRECISION`. Lane j codes the ids j, j + lanes, j + 2 * lanes and so on; all lanes share one stream
of 32-bit words, so that numpy codes a whole row of lanes at a time. A state stays in [2^31, 2^63). The encoder runs
backwards, the decoder forwards; every `CHECKPOINT` rows the states and the place in the stream are kept, so that
decoding can start there.
"""

import struct
import zlib

import numpy as np

PRECISION = 22
LANES = 256
CHECKPOINT = 1024
MAGIC = b"BWR1"
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sIQIIII")  # magic, lanes, ids, words, checkpoints, crc of the ids, crc of the words
S32, WORD = np.uint64(32), np.uint64(0xFFFFFFFF)


class Table:
    """Shares of the tokens: sorted ids, their frequencies and starts, summing to 2^PRECISION."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens = np.asarray(tokens, np.int64)[order]
        counts = np.asarray(counts, np.float64)[order]
        total = 1 << PRECISION
        if len(counts) >= total:
            raise ValueError("more distinct tokens than shares")
        shares = np.maximum(1, np.floor(counts / max(1.0, counts.sum()) * (total - len(counts)))).astype(np.int64)
        if len(shares):
            shares[np.argmax(shares)] += total - shares.sum()
        self.share = shares.astype(np.uint64)
        self.start = (np.cumsum(shares) - shares).astype(np.uint64)
        self.slot = None

    def slots(self) -> np.ndarray:
        """The token index of every share; built where decoding happens."""
        if self.slot is None:
            self.slot = np.repeat(np.arange(len(self.share), dtype=np.int32), self.share.astype(np.int64))
        return self.slot


def encode(ids: np.ndarray, table: Table, lanes: int = LANES) -> bytes:
    """One independent block. Every id must be in the table."""
    ids = np.asarray(ids, np.int64)
    index = np.searchsorted(table.tokens, ids)
    if len(ids) and (index.max() >= len(table.tokens) or (table.tokens[index] != ids).any()):
        raise ValueError("an id is not in the table")
    rows = -(-len(ids) // lanes)
    state = np.full(lanes, LOW)
    chunks, marks, n_words = [], [], 0
    up, share, start = np.uint64(63 - PRECISION), table.share[index], table.start[index]
    bits = np.uint64(PRECISION)
    for row in range(rows - 1, -1, -1):
        f, c = share[row * lanes : (row + 1) * lanes], start[row * lanes : (row + 1) * lanes]
        s = state[: len(f)]
        full = s >= (f << up)
        if full.any():
            chunks.append((s[full] & WORD).astype(np.uint32)[::-1])  # the stream is turned round at the end
            n_words += len(chunks[-1])
            s = np.where(full, s >> S32, s)
        state[: len(f)] = ((s // f) << bits) + (s % f) + c
        if row % CHECKPOINT == 0:
            marks.append((n_words, state.copy()))
    words = np.concatenate(chunks)[::-1] if chunks else np.zeros(0, np.uint32)
    places = np.array([n_words - at for at, _ in reversed(marks)], np.uint64)
    states = np.concatenate([s for _, s in reversed(marks)]) if marks else np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(words).astype("<u4").tobytes()
    check = zlib.crc32(ids.astype("<u4").tobytes())
    head = HEAD.pack(MAGIC, lanes, len(ids), len(words), len(marks), check, zlib.crc32(raw))
    return head + places.astype("<u8").tobytes() + states.astype("<u8").tobytes() + raw


def decode(block: bytes, table: Table, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids from checkpoint `start` to before checkpoint `stop`; the whole block is checked against its sums."""
    magic, lanes, n, n_words, n_marks, check, sum_words = HEAD.unpack_from(block)
    at = HEAD.size + 8 * n_marks + 8 * n_marks * lanes
    raw = block[at:]
    if magic != MAGIC or len(raw) != 4 * n_words or zlib.crc32(raw) != sum_words:
        raise ValueError("a damaged block")
    words = np.frombuffer(raw, "<u4").astype(np.uint64)
    places = np.frombuffer(block, "<u8", n_marks, HEAD.size)
    states = np.frombuffer(block, "<u8", n_marks * lanes, HEAD.size + 8 * n_marks).reshape(n_marks, lanes)
    rows = -(-n // lanes)
    last = rows if stop is None else min(rows, stop * CHECKPOINT)
    slots, share, begin = table.slots(), table.share, table.start
    out, bits, mask = [], np.uint64(PRECISION), np.uint64((1 << PRECISION) - 1)
    state, place = None, 0
    for row in range(start * CHECKPOINT, last):
        if row % CHECKPOINT == 0:
            state, place = states[row // CHECKPOINT].copy(), int(places[row // CHECKPOINT])
        width = min(lanes, n - row * lanes)
        s = state[:width]
        slot = s & mask
        symbol = slots[slot.astype(np.int64)]
        s = share[symbol] * (s >> bits) + slot - begin[symbol]
        low = np.flatnonzero(s < LOW)
        if len(low):
            s[low] = s[low] << S32 | words[place : place + len(low)]
            place += len(low)
        state[:width] = s
        out.append(symbol)
    ids = table.tokens[np.concatenate(out)] if out else np.zeros(0, np.int64)
    if start == 0 and stop is None and zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("ids do not match their checksum")
    return ids
