"""CRC-32C of many byte strings at once, with numpy.

The checksum is linear over GF(2): strings are padded in front with zeros,
which a zero register ignores, cut into blocks, and all blocks of all strings
advance together, four bytes a step; then each string's block remainders are
chained by the linear map of a block's length.
"""

from __future__ import annotations

import functools

import numpy as np

#: The reversed Castagnoli polynomial.
POLY = 0x82F63B78
BLOCK = 256


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(POLY), byte >> 1)

    def advance(x: np.ndarray, n: int) -> np.ndarray:
        for _ in range(n):
            x = byte[x & 0xFF] ^ (x >> 8)
        return x

    half = np.arange(1 << 16, dtype=np.uint32)
    low, high = advance(half, 4), advance(half << np.uint32(16), 4)
    shift = [advance(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), BLOCK) for k in range(4)]
    return low, high, shift


def crc32c(data: bytes | np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of each ``data[start:start + length]``, as uint32."""
    low, high, shift = _tables()
    buf = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, bytearray, memoryview)) else data
    starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    n = len(lengths)
    # 4 bytes in front take the register's initial ones: they are xored into the first 4 bytes
    blocks = np.maximum(1, -(-lengths // BLOCK))
    out = np.zeros(n, np.uint32)
    order = np.argsort(-blocks, kind="stable")
    done = 0
    while done < n:
        # groups of at most about 4 MB, or one string
        upto = done + max(1, int(np.searchsorted(np.cumsum(blocks[order[done:]]), (4 << 20) // BLOCK, "right")))
        take = order[done:upto]
        out[take] = _group(buf, starts[take], lengths[take], blocks[take], low, high, shift)
        done = upto
    return out


def _group(buf, starts, lengths, blocks, low, high, shift):
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    padded = np.zeros(int(blocks.sum()) * BLOCK, np.uint8)
    for s, n, b, k in zip(starts.tolist(), lengths.tolist(), first.tolist(), blocks.tolist(), strict=True):
        end = (b + k) * BLOCK
        padded[end - n : end] = buf[s : s + n]
        head = padded[end - n : min(end, end - n + 4)]
        head ^= 0xFF
    words = padded.view("<u4").reshape(-1, BLOCK // 4)
    reg = np.zeros(len(words), np.uint32)
    for j in range(BLOCK // 4):
        reg ^= words[:, j]
        reg = low[reg & 0xFFFF] ^ high[reg >> 16]
    acc = np.zeros(len(blocks), np.uint32)
    for j in range(int(blocks[0]) if len(blocks) else 0):
        live = int(np.searchsorted(-blocks, -j, "left"))  # blocks fall: the first strings have more than j
        a = acc[:live]
        a = shift[0][a & 0xFF] ^ shift[1][(a >> 8) & 0xFF] ^ shift[2][(a >> 16) & 0xFF] ^ shift[3][a >> 24]
        acc[:live] = a ^ reg[first[:live] + j]
    # strings under 4 bytes: the ones that fell outside act as a register shifted by the string's length
    short = np.flatnonzero(lengths < 4)
    acc ^= np.uint32(0xFFFFFFFF)
    for i in short.tolist():
        acc[i] = _plain(buf[starts[i] : starts[i] + lengths[i]].tobytes())
    return acc


def _plain(data: bytes) -> int:
    reg = 0xFFFFFFFF
    for b in data:
        reg ^= b
        for _ in range(8):
            reg = (reg >> 1) ^ (POLY if reg & 1 else 0)
    return reg ^ 0xFFFFFFFF


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated right by 15 bits plus a constant, so that stored checksums of data that hold checksums stay good."""
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)
