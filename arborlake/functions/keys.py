"""Content keys as column expressions.

A key has 32 bytes: a header (bits 7-4 object type, bit 3 zero, bits 2-0 the
number of length bytes less one), the object's logical length in as few
big-endian bytes as hold it, and the front of the content hash.  Expressions
here work on lowercase hex strings, so that SQL engines agree on them byte by
byte; ``unhex`` turns them into BINARY.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Object types. Fixed values.
BLOB, FILE_NODE, DIR_LEAF, DIR_NODE, XATTR_SET = range(5)
KEY_BYTES = 32
#: A record has this many bytes before its payload, a segment before its records. Fixed values.
RECORD_HEADER, SEGMENT_HEADER = 46, 8


def length_hex(length: Column) -> Column:
    """Minimal big-endian length; zero takes one byte."""
    digits = F.lower(F.hex(length.cast("long")))
    return F.lpad(digits, (F.floor((F.length(digits) + 1) / 2) * 2).cast("int"), F.lit("0"))


def key_hex(kind: int | Column, length: Column, digest: Column) -> Column:
    """Key of an object of this type and logical length; ``digest``: hash of its bytes as 64 hex digits."""
    kind = F.lit(kind) if isinstance(kind, int) else kind
    size = length_hex(length)
    count = F.length(size) / 2
    header = F.lpad(F.lower(F.hex((kind * 16 + count - 1).cast("long"))), 2, "0")
    return F.concat(header, size, F.substring(digest, F.lit(1), (2 * (KEY_BYTES - 1 - count)).cast("int")))


def text_key(text: Column) -> Column:
    """Key of a text's bytes as a blob, with SHA-256 as the content hash."""
    return key_hex(BLOB, F.octet_length(text), F.sha2(text, 256))


def _byte(key: Column, i: int) -> Column:
    return F.conv(F.substring(key, 2 * i + 1, 2), 16, 10).cast("int")


def key_type(key: Column) -> Column:
    return F.shiftright(_byte(key, 0), 4)


def key_length_bytes(key: Column) -> Column:
    return _byte(key, 0).bitwiseAND(7) + 1


def key_length(key: Column) -> Column:
    """Logical length as an unsigned decimal string beyond 2^63, exact in any case: DECIMAL(20, 0)."""
    return F.conv(F.substring(key, F.lit(3), 2 * key_length_bytes(key)), 16, 10).cast("decimal(20,0)")


def key_digest(key: Column) -> Column:
    return F.substring(key, 2 * key_length_bytes(key) + 3, F.lit(64))


def key_error(key: Column) -> Column:
    """Why a key isn't canonical, or null: size, reserved_bit, reserved_type or length_padding."""
    return (
        F.when(key.isNull() | ~key.rlike("^[0-9a-f]{64}$"), "size")
        .when(_byte(key, 0).bitwiseAND(8) != 0, "reserved_bit")
        .when(key_type(key) > XATTR_SET, "reserved_type")
        .when((key_length_bytes(key) > 1) & (_byte(key, 1) == 0), "length_padding")
    )


def split_key_list(keys: Column) -> Column:
    """Concatenated keys (hex) as an array; a length that is no multiple of a key gives null."""
    n = F.length(keys) / 64
    return F.when(F.length(keys) % 64 == 0, F.when(F.length(keys) > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.substring(keys, i * 64 + 1, F.lit(64)))).otherwise(F.array().cast("array<string>")))
