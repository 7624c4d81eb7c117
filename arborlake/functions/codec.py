"""Byte formats of stored objects: deterministic CBOR, object encodings, records and packs.

CBOR follows RFC 8949's core deterministic form.  A record is a header (tag,
key, flags, plain length, stored length, CRC-32C; big-endian) and a payload,
compressed with zstd only where that makes it smaller.  A pack is a magic, some
records, and an end tag.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .hashing import blake3_many, crc32c
from .keys import BLOB, DIR_LEAF, DIR_NODE, FILE_NODE, KEY_BYTES, RECORD_HEADER, XATTR_SET

#: Tags, flag and bound of records. Fixed values.
TAG_END, TAG_RECORD, FLAG_ZSTD, MAX_PAYLOAD = 0, 1, 1, 256 << 20
#: Attributes of at most this many encoded bytes stay in their entry. Fixed value.
INLINE_XATTRS = 256
#: An own pack format's magic; to read or write packs of another store, pass its own.
MAGIC = b"OBJPACK\x03"


class Malformed(ValueError):
    """Bytes that aren't what they should be."""


# CBOR


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << (8 * size):
            return bytes([major << 5 | code]) + n.to_bytes(size, "big")
    raise Malformed("integer beyond 64 bits")


def encode(x) -> bytes:
    """Deterministic CBOR of integers, bytes, text, lists, maps, booleans and None."""
    if x is None:
        return b"\xf6"
    if isinstance(x, bool):
        return b"\xf5" if x else b"\xf4"
    if isinstance(x, int):
        return _head(0, x) if x >= 0 else _head(1, -1 - x)
    if isinstance(x, (bytes, bytearray)):
        return _head(2, len(x)) + bytes(x)
    if isinstance(x, str):
        return _head(3, len(x.encode())) + x.encode()
    if isinstance(x, (list, tuple)):
        return _head(4, len(x)) + b"".join(map(encode, x))
    if isinstance(x, dict):
        return _head(5, len(x)) + b"".join(k + v for k, v in sorted((encode(k), encode(v)) for k, v in x.items()))
    raise TypeError(type(x))


def _decode(b: bytes, at: int, depth: int = 0) -> tuple[object, int]:
    if at >= len(b) or depth > 64:
        raise Malformed("truncated or too deep")
    major, n, at = b[at] >> 5, b[at] & 31, at + 1
    if major == 7:
        if n not in (20, 21, 22):
            raise Malformed("unknown simple value")
        return {20: False, 21: True, 22: None}[n], at
    if n > 27:
        raise Malformed("indefinite or reserved length")
    if n >= 24:
        size = 1 << (n - 24)
        if at + size > len(b):
            raise Malformed("truncated head")
        value = int.from_bytes(b[at : at + size], "big")
        if _head(major, value)[0] & 31 != n:
            raise Malformed("length isn't minimal")
        n, at = value, at + size
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        if at + n > len(b):
            raise Malformed("truncated string")
        raw = bytes(b[at : at + n])
        try:
            return raw if major == 2 else raw.decode(), at + n
        except UnicodeDecodeError as e:
            raise Malformed("text isn't UTF-8") from e
    if n > len(b) - at:
        raise Malformed("more items than bytes")
    if major == 4:
        items = []
        for _ in range(n):
            x, at = _decode(b, at, depth + 1)
            items.append(x)
        return items, at
    if major == 5:
        out, last = {}, b""
        for _ in range(n):
            start = at
            k, at = _decode(b, at, depth + 1)
            if b[start:at] <= last:
                raise Malformed("map keys aren't in order")
            last = bytes(b[start:at])
            out[k], at = _decode(b, at, depth + 1)
        return out, at
    raise Malformed("tags aren't supported")


def decode(b: bytes):
    x, at = _decode(b, 0)
    if at != len(b):
        raise Malformed("trailing bytes")
    return x


def to_json(x):
    """A decoded value with keys as text and bytes as text or hex, for ``json.dumps``."""
    if isinstance(x, bytes):
        try:
            return x.decode()
        except UnicodeDecodeError:
            return x.hex()
    if isinstance(x, dict):
        return {str(to_json(k)): to_json(v) for k, v in x.items()}
    return [to_json(v) for v in x] if isinstance(x, list) else x


@F.pandas_udf(StringType())
def cbor_json(payload: pd.Series) -> pd.Series:
    """A CBOR payload as JSON, null where it is none."""

    def one(b) -> str | None:
        try:
            return None if b is None else json.dumps(to_json(decode(bytes(b))), ensure_ascii=False, separators=(",", ":"))
        except Malformed:
            return None

    return payload.map(one)


# keys and objects


def make_key(kind: int, length: int, digest: bytes) -> bytes:
    size = length.to_bytes(max(1, -(-length.bit_length() // 8)), "big")
    return bytes([kind << 4 | len(size) - 1]) + size + digest[: KEY_BYTES - 1 - len(size)]


def key_parts(key: bytes) -> tuple[int, int, bytes]:
    """(type, logical length, hash) of a canonical key."""
    if len(key) != KEY_BYTES:
        raise Malformed("size")
    n = (key[0] & 7) + 1
    if key[0] & 8:
        raise Malformed("reserved_bit")
    if key[0] >> 4 > XATTR_SET:
        raise Malformed("reserved_type")
    if n > 1 and key[1] == 0:
        raise Malformed("length_padding")
    return key[0] >> 4, int.from_bytes(key[1 : 1 + n], "big"), key[1 + n :]


def build(kind: int, content) -> tuple[bytes, bytes]:
    """(key, payload) of an object.

    content: bytes of a blob; child keys of a file node; entries of a leaf, as
    dicts of the integer fields 0 (name) to 9; (separator, child key) pairs of a
    directory node; names to values of an attribute set.
    """
    if kind == BLOB:
        payload, length = bytes(content), len(content)
    elif kind == FILE_NODE:
        payload, length = encode(list(content)), sum(key_parts(k)[1] for k in content)
    elif kind == DIR_LEAF:
        payload = encode([{k: v for k, v in e.items() if k < 5 or v} for e in content])
        length = len(payload) + sum(key_parts(e[k])[1] for e in content for k in (5, 9) if e.get(k))
    elif kind == DIR_NODE:
        payload = encode([list(p) for p in content])
        length = len(payload) + sum(key_parts(k)[1] for _, k in content)
    elif kind == XATTR_SET:
        payload = encode(content)
        length = len(payload)
    else:
        raise Malformed("reserved_type")
    return make_key(kind, length, blake3_many([payload])[0]), payload


def children(key: bytes, payload: bytes) -> list[bytes]:
    """Keys that an object refers to, in order; blobs and attribute sets have none."""
    kind = key_parts(key)[0]
    if kind == FILE_NODE:
        return decode(payload)
    if kind == DIR_NODE:
        return [k for _, k in decode(payload)]
    if kind == DIR_LEAF:
        return [e[k] for e in decode(payload) for k in (5, 9) if k in e]
    return []


def verify(key: bytes, payload: bytes) -> str | None:
    """Why an object isn't what its key says, or None: its hash, and its length where that is its own size."""
    kind, length, digest = key_parts(key)
    if blake3_many([payload])[0][: len(digest)] != digest:
        return "hash"
    return "length" if kind in (BLOB, XATTR_SET) and length != len(payload) else None


# records and packs


def encode_record(key: bytes, payload: bytes) -> bytes:
    if len(payload) > MAX_PAYLOAD:
        raise Malformed("payload too large")
    packed = zstandard.ZstdCompressor().compress(payload)
    stored, flags = (packed, FLAG_ZSTD) if len(packed) < len(payload) else (payload, 0)
    head = struct.pack(">B32sBII", TAG_RECORD, key, flags, len(payload), len(stored))
    return head + struct.pack(">I", crc32c(stored, crc32c(head + b"\0\0\0\0"))) + stored


def parse_record(b: bytes, at: int = 0) -> tuple[bytes, bytes, int]:
    """(key, payload, end) of the record at a place."""
    if len(b) - at < RECORD_HEADER:
        raise Malformed("header")
    tag, key, flags, plain, stored = struct.unpack_from(">B32sBII", b, at)
    if tag != TAG_RECORD:
        raise Malformed("tag")
    if flags & ~FLAG_ZSTD:
        raise Malformed("flags")
    end = at + RECORD_HEADER + stored
    if end > len(b):
        raise Malformed("payload")
    if not flags and plain != stored or flags and stored >= plain or plain > MAX_PAYLOAD:
        raise Malformed("lengths")
    body = bytes(b[at + RECORD_HEADER : end])
    if crc32c(body, crc32c(bytes(b[at : at + RECORD_HEADER - 4]) + b"\0\0\0\0")) != struct.unpack_from(">I", b, at + RECORD_HEADER - 4)[0]:
        raise Malformed("checksum")
    key_parts(key)
    if flags:
        try:
            body = zstandard.ZstdDecompressor().decompress(body, max_output_size=plain)
        except zstandard.ZstdError as e:
            raise Malformed("compression") from e
        if len(body) != plain:
            raise Malformed("length after decompression")
    return key, body, end


def encode_pack(objects: list[tuple[bytes, bytes]], magic: bytes = MAGIC) -> bytes:
    return magic + b"".join(encode_record(k, p) for k, p in objects) + bytes([TAG_END])


def parse_pack(b: bytes, magic: bytes = MAGIC) -> Iterator[tuple[bytes, bytes, int]]:
    """(key, payload, offset) of each record; Malformed where the bytes stop making sense."""
    if not b.startswith(magic):
        raise Malformed("magic")
    at = len(magic)
    while True:
        if at >= len(b):
            raise Malformed("no end tag")
        if b[at] == TAG_END:
            if at + 1 != len(b):
                raise Malformed("trailing bytes")
            return
        key, payload, end = parse_record(b, at)
        yield key, payload, at
        at = end


def valid_prefix(b: bytes, start: int) -> tuple[list[tuple[bytes, int]], int]:
    """Records of an unfinished segment up to the first invalid byte: ((key, offset) list, where they end)."""
    out, at = [], start
    while at < len(b):
        try:
            key, _, end = parse_record(b, at)
        except Malformed:
            break
        out.append((key, at))
        at = end
    return out, at
