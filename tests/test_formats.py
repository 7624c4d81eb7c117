"""Hashes, codecs, chunking and packs."""

import io
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborlake.functions import chunking, codec
from arborlake.functions.hashing import _table, blake3_many, crc32c
from arborlake.sources import files, packs

random.seed(1)


def test_blake3_published_vectors():
    data = bytes(i % 251 for i in range(31744))
    want = {0: "af1349b9f5f9a1a6", 1024: "42214739f095a406", 1025: "d00278ae47eb27b3", 2049: "5f4d72f40d7a5f82", 3073: "7124b49501012f81", 31744: "62b6960e1a44bcc1"}
    got = blake3_many([data[:n] for n in want])
    assert [h.hex()[:16] for h in got] == list(want.values())


def test_known_key():
    key, _ = codec.build(codec.BLOB, b"hello")
    assert key.hex().startswith("0005ea8f163db386") and len(key) == 32


def test_crc32c_published_value():
    assert crc32c(b"123456789") == 0xE3069283
    data = random.randbytes(5000)
    for n in (0, 1, 1023, 1024, 1025, 4096, 5000):
        assert crc32c(data[:n]) == crc32c(data[500:n], crc32c(data[: min(n, 500)]))
    table = _table()
    crc = 0xFFFFFFFF
    for x in data:
        crc = table[(crc ^ x) & 0xFF] ^ (crc >> 8)
    assert crc32c(data) == crc ^ 0xFFFFFFFF


values = st.recursive(st.none() | st.booleans() | st.integers(-(2**64), 2**64 - 1) | st.binary(max_size=40) | st.text(max_size=20), lambda x: st.lists(x, max_size=5) | st.dictionaries(st.integers(0, 30) | st.binary(max_size=5), x, max_size=5), max_leaves=20)


@given(values)
@settings(max_examples=200, deadline=None)
def test_cbor_round_trip(x):
    b = codec.encode(x)
    assert codec.decode(b) == x and codec.encode(codec.decode(b)) == b


@pytest.mark.parametrize("bad", [b"", b"\x18\x05", b"\x42\x01", b"\x01\x02", b"\x5f", b"\xa2\x02\x00\x01\x00", b"\x9b" + b"\xff" * 8, b"\xc0\x01"])
def test_cbor_refuses(bad):
    with pytest.raises(codec.Malformed):
        codec.decode(bad)


def test_attribute_order_is_by_encoded_key():
    assert codec.encode({b"aa": b"", b"b": b""}) == bytes.fromhex("a241624042616140")


def test_object_lengths():
    a, b = codec.build(codec.BLOB, b"x" * 300)[0], codec.build(codec.BLOB, b"")[0]
    node, payload = codec.build(codec.FILE_NODE, [a, b])
    assert codec.key_parts(node)[:2] == (codec.FILE_NODE, 300) and codec.children(node, payload) == [a, b]
    leaf, body = codec.build(codec.DIR_LEAF, [{0: b"f", 1: 0o100644, 2: 0, 3: 0, 4: -5, 5: node, 6: b""}])
    assert codec.key_parts(leaf)[1] == len(body) + 300 and codec.children(leaf, body) == [node]
    top, body2 = codec.build(codec.DIR_NODE, [(b"f", leaf)])
    assert codec.key_parts(top)[1] == len(body2) + len(body) + 300
    assert codec.key_parts(b)[1] == 0 and b[1] == 0


@pytest.mark.parametrize(("change", "error"), [(lambda k: k[:31], "size"), (lambda k: bytes([k[0] | 8]) + k[1:], "reserved_bit"), (lambda k: bytes([0x70 | k[0]]) + k[1:], "reserved_type"), (lambda k: b"\x01\x00" + k[2:], "length_padding")])
def test_key_errors(change, error):
    with pytest.raises(codec.Malformed, match=error):
        codec.key_parts(change(codec.build(codec.BLOB, b"hello")[0]))


def test_pack_truncated_anywhere_or_changed():
    objects = [codec.build(codec.BLOB, x) for x in (b"", b"a" * 5000, os.urandom(700))]
    pack = codec.encode_pack(objects)
    assert [(k, p) for k, p, _ in codec.parse_pack(pack)] == objects
    for n in range(0, len(pack), 7):
        with pytest.raises(codec.Malformed):
            list(codec.parse_pack(pack[:n]))
    for at in (3, 9, 45, 50, len(pack) - 30):
        with pytest.raises(codec.Malformed):
            list(codec.parse_pack(pack[:at] + bytes([pack[at] ^ 1]) + pack[at + 1 :]))
    assert list(codec.parse_pack(codec.encode_pack([]))) == []


def test_valid_prefix_stops_at_first_bad_byte():
    body = b"".join(codec.encode_record(*codec.build(codec.BLOB, bytes([i]) * 100)) for i in range(4))
    found, end = codec.valid_prefix(body, 0)
    assert len(found) == 4 and end == len(body)
    cut = found[2][1]
    assert codec.valid_prefix(body[: cut + 20], 0)[1] == cut


def test_cuts_bounds_and_content():
    data = os.urandom(200_000)
    ends = chunking.cuts(data, 1000, 4000, 9000)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(data) and max(sizes) <= 9000 and min(sizes[:-1]) >= 1000
    shifted = chunking.cuts(b"new" + data, 1000, 4000, 9000)
    assert len({e - 3 for e in shifted} & set(ends)) > len(ends) * 0.8
    assert chunking.cuts(b"") == [] and chunking.cuts(b"x") == [1]


def test_chunked(spark):
    rows = [(1, bytes(3000)), (2, b""), (3, None), (4, os.urandom(50_000))]
    out = chunking.chunked(spark.createDataFrame(rows, "id long, content binary"), least=1000, average=4000, most=9000).collect()
    whole = {i: b"".join(bytes(r.chunk) for r in sorted(out, key=lambda r: r.pos) if r.id == i) for i in (1, 2, 4)}
    assert whole == {i: c for i, c in rows if c is not None} and [r.pos for r in out if r.id == 2] == [0]


def test_packs(spark, tmp_path):
    objects = [codec.build(codec.BLOB, os.urandom(i * 50)) for i in range(20)]
    spark.dataSource.register(packs.PackSink)
    df = spark.createDataFrame(objects, "key binary, payload binary").repartition(3)
    df.write.format("objectpack").mode("append").save(str(tmp_path / "p"))
    back = packs.read_packs(spark, str(tmp_path / "p"))
    assert sorted((bytes(r.key), bytes(r.payload)) for r in back.collect()) == sorted(objects)
    assert back.where("error IS NOT NULL").isEmpty()
    (tmp_path / "p" / "bad.pack").write_bytes(b"what")
    (tmp_path / "p" / "wrong.pack").write_bytes(codec.encode_pack([(objects[1][0], b"other")]))
    errors = {os.path.basename(r.file): r.error for r in packs.read_packs(spark, str(tmp_path / "p")).where("error IS NOT NULL").collect()}
    assert errors == {"bad.pack": "magic", "wrong.pack": "hash"}


def test_tree_and_tar(spark, tmp_path):
    src = tmp_path / "src"
    (src / "d").mkdir(parents=True)
    (src / "a").write_bytes(b"tiny")
    (src / "d" / "big").write_bytes(b"ab" * 100_000)
    os.symlink("a", src / "link")
    os.mkfifo(src / "pipe")
    for f in ("a", "d/big", "d"):
        os.utime(src / f, ns=(10**18 + 5, 10**18 + 5))
    spark.dataSource.register(files.TreeSource)
    rows = spark.read.format("filetree").load(str(src))
    assert [(r.path, r.kind) for r in rows.orderBy("path").collect()] == [("a", "file"), ("d", "dir"), ("d/big", "file"), ("link", "symlink"), ("pipe", "fifo")]
    out = io.BytesIO()
    assert files.write_tar(rows, out) == 5
    out.seek(0)
    to = tmp_path / "to"
    to.mkdir()
    assert files.extract_tar(out, str(to)) == 5
    assert (to / "d" / "big").read_bytes() == b"ab" * 100_000 and os.readlink(to / "link") == "a"
    assert abs(os.stat(to / "d").st_mtime - 10**9) < 1
    with pytest.raises(ValueError, match="unsafe"):
        files.write_tar(rows.selectExpr("'../x' AS path", "kind", "mode", "uid", "gid", "mtime_ns", "size", "content", "link_target", "rdev", "xattrs"), io.BytesIO())
    with pytest.raises(ValueError, match="read"):
        files.write_tar(spark.read.format("filetree").option("max_bytes", 100).load(str(src)), io.BytesIO())
    assert len(files.TreeReader(str(src), True, 1 << 30, 64).partitions()) == 5 and len(files.TreeReader(str(src), True, 1 << 30, 1).partitions()) == 4
    few = spark.read.format("filetree").option("splits", 1).load(str(src))
    assert sorted(map(tuple, few.select("path", "kind", "size").collect())) == sorted(map(tuple, rows.select("path", "kind", "size").collect()))


def test_cbor_as_json(spark):
    rows = [(1, codec.encode({1: [b"a", b"\xff", None], b"k": {"x": -2}})), (2, b"\xff"), (3, None)]
    got = {r.id: r.j for r in spark.createDataFrame(rows, "id int, b binary").select("id", codec.cbor_json("b").alias("j")).collect()}
    assert got == {1: '{"1":["a","ff",null],"k":{"x":-2}}', 2: None, 3: None}
