"""Scalar expressions over entries, names, sizes and payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File types of POSIX modes. Fixed values.
KINDS = ((0o040000, "dir", "d"), (0o100000, "file", "-"), (0o120000, "symlink", "l"), (0o010000, "fifo", "p"), (0o020000, "char", "c"), (0o060000, "block", "b"), (0o140000, "socket", "s"))
UNITS = ("KiB", "MiB", "GiB", "TiB", "PiB", "EiB")


def entry_kind(mode: Column) -> Column:
    out = F.lit("unknown")
    for bits, name, _ in KINDS:
        out = F.when(mode.bitwiseAND(0o170000) == bits, name).otherwise(out)
    return out


def mode_string(mode: Column) -> Column:
    """As ``ls -l`` shows it, with setuid, setgid and sticky in the execute places."""
    head = F.lit("?")
    for bits, _, letter in KINDS:
        head = F.when(mode.bitwiseAND(0o170000) == bits, letter).otherwise(head)
    out = [head]
    for shift, special, with_x, without_x in ((6, 0o4000, "s", "S"), (3, 0o2000, "s", "S"), (0, 0o1000, "t", "T")):
        x = mode.bitwiseAND(1 << shift) != 0
        out.append(F.when(mode.bitwiseAND(4 << shift) != 0, "r").otherwise("-"))
        out.append(F.when(mode.bitwiseAND(2 << shift) != 0, "w").otherwise("-"))
        out.append(F.when(mode.bitwiseAND(special) != 0, F.when(x, with_x).otherwise(without_x)).otherwise(F.when(x, "x").otherwise("-")))
    return F.concat(*out)


def human_size(size: Column) -> Column:
    """Bytes below 1024, else one decimal in the largest unit that leaves at least 1."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for i, unit in enumerate(UNITS):
        step = 1024 ** (i + 1)
        out = F.when(size >= step, F.concat(F.round(size / step, 1).cast("decimal(20,1)").cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def name_error(name: Column, allow_at: bool = False) -> Column:
    """Why a reference or user name isn't valid, or null: length (1 to 1024 bytes), encoding (not UTF-8), at or control."""
    out = F.when(name.isNull() | (F.octet_length(name) < 1) | (F.octet_length(name) > 1024), "length").when(~F.is_valid_utf8(name), "encoding")
    if not allow_at:
        out = out.when(F.contains(name, F.lit("@")), "at")
    return out.when(name.rlike(r"[\x00-\x1F\x7F-\x{9F}]"), "control")


def path_parts(path: Column) -> Column:
    """Components of a path: empty ones and ``.`` are skipped; a path with ``..`` gives null."""
    parts = F.filter(F.split(path, "/", -1), lambda x: (x != "") & (x != "."))
    return F.when(~F.array_contains(F.split(path, "/", -1), ".."), parts)


def unsafe_name(name: Column) -> Column:
    return name.isNull() | name.isin("", ".", "..") | F.contains(name, F.lit("/"))


def is_textual(payload: Column, head: int = 8192) -> Column:
    """Valid UTF-8 in its first bytes (a character cut off at their end is forgiven), no NUL, at most 30 % control bytes."""
    part = F.substring(payload, 1, head)
    whole = part.cast("string")
    valid = F.is_valid_utf8(whole)
    for back in (1, 2, 3):
        valid = valid | ((F.octet_length(payload) > head) & F.is_valid_utf8(F.substring(part, 1, head - back).cast("string")))
    shown = F.make_valid_utf8(whole)
    controls = F.length(F.regexp_replace(shown, r"[^\x01-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    return valid & ~F.contains(shown, F.lit("\x00")) & (controls * 10 <= F.octet_length(part) * 3)


def hex_dump(payload: Column) -> Column:
    """Lines of offset, hex and ASCII for every 16 bytes, as an array."""
    rows = F.floor((F.octet_length(payload) + 15) / 16).cast("int")

    def line(i: Column) -> Column:
        part = F.lower(F.hex(F.substring(payload, i * 16 + 1, F.lit(16))))
        shown = F.regexp_replace(F.decode(F.substring(payload, i * 16 + 1, F.lit(16)), "ISO-8859-1"), r"[^\x20-\x7E]", ".")
        return F.concat(F.lpad(F.lower(F.hex((i * 16).cast("long"))), 8, "0"), F.lit("  "), F.rpad(F.rtrim(F.regexp_replace(part, "(..)", "$1 ")), 47, " "), F.lit("  |"), shown, F.lit("|"))

    return F.when(rows > 0, F.transform(F.sequence(F.lit(0), rows - 1), line)).otherwise(F.array().cast("array<string>"))


def show_time(mtime_ns: Column, now_ns: Column) -> Column:
    """Day and clock within six months of now, day and year otherwise (UTC)."""
    at, now = F.timestamp_seconds(F.floor(mtime_ns / 1_000_000_000)), F.timestamp_seconds(F.floor(now_ns / 1_000_000_000))
    near = (at > F.add_months(now, -6)) & (at <= now)
    return F.when(near, F.date_format(at, "MMM dd HH:mm")).otherwise(F.date_format(at, "MMM dd  yyyy"))


def rfc3339_ns(time_ns: Column) -> Column:
    """UTC with the nanoseconds that are needed and no more."""
    rest = F.pmod(time_ns, F.lit(1_000_000_000))
    digits = F.rtrim(F.lpad(rest.cast("string"), 9, "0"), F.lit("0"))
    base = F.date_format(F.timestamp_seconds(F.floor(time_ns / 1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(base, F.when(rest == 0, "").otherwise(F.concat(F.lit("."), digits)), F.lit("Z"))


def segment_number(file_name: Column) -> Column:
    """Number in a segment's file name, 16 lowercase hex digits and a suffix, or null."""
    digits = F.regexp_extract(file_name, r"^([0-9a-f]{16})\.seg$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("decimal(20,0)"))


def fingerprint(public_key: Column) -> Column:
    """Of a base64 public key, as SSH tools show it: SHA-256 in base64 without padding."""
    return F.concat(F.lit("SHA256:"), F.rtrim(F.base64(F.unhex(F.sha2(F.unbase64(public_key), 256))), F.lit("=")))


def shell_quoted(text: Column) -> Column:
    """In single quotes, where a shell would not take the text as it is."""
    plain = text.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$")
    return F.when(plain, text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def base_name(path: Column) -> Column:
    """The last component, without trailing slashes; the root for nothing else."""
    parts = F.filter(F.split(path, "/", -1), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(F.when(path == "", ".").otherwise("/"))


def promoted_size(size: Column) -> Column:
    """As ``human_size``, but 1023.95 and more of a unit is shown as 1.0 of the next."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for i, unit in enumerate(UNITS):
        least = 1024 ** (i + 1) if i == 0 else 1023.95 * 1024**i
        out = F.when(size >= least, F.concat(F.round(size / 1024 ** (i + 1), 1).cast("decimal(20,1)").cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


#: Media types by extension. Fixed values.
MEDIA = (
    ("html", "text/html; charset=utf-8"), ("htm", "text/html; charset=utf-8"), ("css", "text/css; charset=utf-8"), ("js", "text/javascript; charset=utf-8"), ("json", "application/json"), ("xml", "text/xml; charset=utf-8"),
    ("txt", "text/plain; charset=utf-8"), ("png", "image/png"), ("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("gif", "image/gif"), ("svg", "image/svg+xml"), ("webp", "image/webp"), ("pdf", "application/pdf"), ("wasm", "application/wasm"),
)
#: Media types by first bytes (hex). Fixed values.
SIGNATURES = (("89504e470d0a1a0a", "image/png"), ("ffd8ff", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("255044462d", "application/pdf"), ("504b0304", "application/zip"), ("1f8b08", "application/x-gzip"))


def media_type(name: Column, payload: Column) -> Column:
    """By extension, else by the first 512 bytes: known signatures, then text or not."""
    head = F.substring(payload, 1, 512)
    out = F.when(F.lower(F.trim(F.substring(payload, 1, 64).cast("string"))).rlike("^(?:<!doctype html|<html)"), "text/html; charset=utf-8").when(is_textual(head, 512), "text/plain; charset=utf-8").otherwise("application/octet-stream")
    for first, kind in SIGNATURES:
        out = F.when(F.startswith(F.lower(F.hex(head)), F.lit(first)), kind).otherwise(out)
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    for ext, kind in MEDIA:
        out = F.when(extension == ext, kind).otherwise(out)
    return out


def view_mode(payload: Column) -> Column:
    """How a payload is shown: text, json or hex."""
    text = payload.cast("string")
    return F.when(~is_textual(payload), "hex").when(text.rlike(r"^\s*[\[{]") & F.try_parse_json(text).isNotNull(), "json").otherwise("text")


def trailer_parts(body: Column) -> tuple[Column, Column]:
    """(what is signed, signature in base64) of a body that ends in a signature and its length, a big-endian 32-bit number;
    nulls where the length leads outside the body."""
    n = F.octet_length(body)
    size = F.conv(F.hex(F.substring(body, n - 3, F.lit(4))), 16, 10).cast("long")
    good = (n >= 4) & (size <= n - 4)
    return F.when(good, F.substring(body, F.lit(1), (n - 4 - size).cast("int"))), F.when(good, F.substring(body, (n - 3 - size).cast("int"), size.cast("int")).cast("string"))


def attributes_size(attributes: Column) -> Column:
    """Bytes of a map of short byte strings in deterministic CBOR: a head for the map, and for each name and value."""

    def head(n: Column) -> Column:
        return F.when(n < 24, 1).when(n < 256, 2).when(n < 65536, 3).otherwise(5)

    def item(x: Column) -> Column:
        return head(F.octet_length(x)) + F.octet_length(x)

    return head(F.size(attributes)) + F.aggregate(F.map_entries(attributes), F.lit(0), lambda a, e: a + item(e["key"]) + item(e["value"]))
