"""Hashes that Spark lacks: BLAKE3-256 and CRC-32C, as Arrow-batched functions.

BLAKE3 follows its published specification.  All chunks of a batch are
compressed side by side in numpy, one block position at a time, then the trees
are folded level by level.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

#: Initial state and message permutation of BLAKE3. Fixed values.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
COLUMNS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values (lanes x 8) after one block (lanes x 16) in each lane."""
    lanes = len(cv)
    v = [cv[:, i].copy() for i in range(8)] + [np.full(lanes, IV[i], np.uint32) for i in range(4)]
    v += [counter.astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), size.astype(np.uint32), flags.astype(np.uint32)]
    order = list(range(16))
    for _ in range(7):
        for i, (a, b, c, d) in enumerate(COLUMNS):
            for word, r1, r2 in ((2 * i, 16, 12), (2 * i + 1, 8, 7)):
                v[a] = v[a] + v[b] + block[:, order[word]]
                v[d] = _rotate(v[d] ^ v[a], r1)
                v[c] = v[c] + v[d]
                v[b] = _rotate(v[b] ^ v[c], r2)
        order = [order[p] for p in PERMUTATION]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)], axis=1)


def blake3_many(payloads: list[bytes]) -> list[bytes]:
    """The 32-byte BLAKE3 hash of each payload."""
    counts = [max(1, -(-len(p) // 1024)) for p in payloads]
    total = sum(counts)
    data = np.zeros((total, 1024), np.uint8)
    sizes, numbers, alone = np.zeros(total, np.int64), np.zeros(total, np.uint64), np.zeros(total, bool)
    at = 0
    for p, n in zip(payloads, counts, strict=True):
        for i in range(n):
            part = p[i * 1024 : (i + 1) * 1024]
            data[at, : len(part)] = np.frombuffer(part, np.uint8)
            sizes[at], numbers[at], alone[at] = len(part), i, n == 1
            at += 1
    words = data.view("<u4").reshape(total, 16, 16)
    blocks = np.maximum(1, -(-sizes // 64))
    cv = np.tile(np.array(IV, np.uint32), (total, 1))
    for b in range(int(blocks.max(initial=0))):
        live = np.flatnonzero(blocks > b)
        last = blocks[live] == b + 1
        flags = np.where(b == 0, CHUNK_START, 0) | np.where(last, CHUNK_END, 0) | np.where(last & alone[live], ROOT, 0)
        cv[live] = _compress(cv[live], words[live, b], numbers[live], np.minimum(64, sizes[live] - 64 * b), flags)
    trees, at = [], 0
    for n in counts:
        trees.append(cv[at : at + n])
        at += n
    # neighbours pair up at every level; an odd one out moves up as it is, which gives the specified left-heavy tree
    while todo := [i for i, t in enumerate(trees) if len(t) > 1]:
        pairs = np.concatenate([trees[i][: len(trees[i]) // 2 * 2].reshape(-1, 16) for i in todo])
        flags = np.concatenate([np.full(len(trees[i]) // 2, PARENT | (ROOT if len(trees[i]) == 2 else 0)) for i in todo])
        n = len(pairs)
        up = _compress(np.tile(np.array(IV, np.uint32), (n, 1)), pairs, np.zeros(n, np.uint64), np.full(n, 64), flags)
        at = 0
        for i in todo:
            half = len(trees[i]) // 2
            trees[i] = np.concatenate([up[at : at + half], trees[i][2 * half :]])
            at += half
    return [t[0].astype("<u4").tobytes() for t in trees]


@cache
def _table() -> list[int]:
    """Remainders of single bytes by the reversed Castagnoli polynomial."""
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0x82F63B78 if i & 1 else 0)
        out.append(i)
    return out


CRC_BLOCK = 1024


@cache
def _places() -> tuple[np.ndarray, np.ndarray]:
    """What a byte adds to the remainder by its distance from the end of a block, and what each byte of a remainder becomes
    after a block of zeros: remainders are linear, so a block is the exclusive or of its bytes' parts."""
    one = np.array(_table(), np.uint32)
    step = lambda x: one[x & np.uint32(255)] ^ (x >> np.uint32(8))
    place = np.empty((CRC_BLOCK, 256), np.uint32)
    place[-1] = one
    for i in range(CRC_BLOCK - 2, -1, -1):
        place[i] = step(place[i + 1])
    after = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    for _ in range(CRC_BLOCK):
        after = step(after)
    return place, after


def crc32c(data: bytes, crc: int = 0) -> int:
    crc ^= 0xFFFFFFFF
    whole = len(data) // CRC_BLOCK * CRC_BLOCK
    if whole:
        place, after = _places()
        own = np.bitwise_xor.reduce(place[np.arange(CRC_BLOCK), np.frombuffer(data, np.uint8, whole).reshape(-1, CRC_BLOCK)], axis=1)
        a, b, c, d = (x.tolist() for x in after)
        for x in own.tolist():
            crc = a[crc & 255] ^ b[crc >> 8 & 255] ^ c[crc >> 16 & 255] ^ d[crc >> 24] ^ x
    table = _table()
    for x in data[whole:]:
        crc = table[(crc ^ x) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


@F.pandas_udf(BinaryType())
def blake3(payload: pd.Series) -> pd.Series:
    """BLAKE3-256 of BINARY values; null stays null."""
    known = payload.notna()
    out = pd.Series([None] * len(payload), index=payload.index, dtype=object)
    if known.any():
        out[known] = pd.Series(blake3_many([bytes(x) for x in payload[known]]), index=payload.index[known], dtype=object)
    return out


@F.pandas_udf(LongType())
def crc32c_of(payload: pd.Series) -> pd.Series:
    return payload.map(lambda x: None if x is None else crc32c(bytes(x))).astype("Int64")
