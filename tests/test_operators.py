"""Folds, trees, graphs and ignore rules against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from arborlake.functions import keys as K
from arborlake.functions import scalars as S
from arborlake.operators import graph, ignore, refs, store, tree
from arborlake.operators.folds import BatchFold, ItemFold, SegmentFold, fold

random.seed(2)


def test_folds(spark):
    rows = [(k, i, random.choice([None, 0, 3, 10, 50])) for k in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, pos long, size long")
    got = {(r.k, r.pos): r.group_no for r in fold(df, BatchFold(60, 5), ["k"], ["pos"], ["size"]).collect()}
    cut = {(r.k, r.pos): r.group_no for r in fold(df, SegmentFold(300), ["k"], ["pos"], ["size"]).collect()}
    for key in ("a", "b", None):
        batch, total, n, seg, fill = 0, 0, 0, 0, 8
        for k, pos, size in rows:
            if k != key:
                continue
            size = size or 0
            if n and (total + size > 60 or n >= 5):
                batch, total, n = batch + 1, 0, 0
            total, n = total + size, n + 1
            assert got[k, pos] == batch and cut[k, pos] == seg
            fill += 46 + size
            if fill >= 300:
                seg, fill = seg + 1, 8


def brute_runs(digests, bits):
    m, out, run, no = ItemFold(bits), [], 0, 0
    for d in digests:
        out.append(no)
        run += 1
        if run >= m.max or run >= m.min and int(d[:2], 16) & ((1 << bits) - 1) == 0:
            run, no = 0, no + 1
    return out


def brute_levels(names, bits):
    items = [(n, hashlib.sha256(n.encode()).hexdigest()) for n in sorted(names)]
    out, level = set(), 0
    while True:
        groups = {}
        for x, r in zip(items, brute_runs([d for _, d in items], bits), strict=True):
            groups.setdefault(r, []).append(x)
        up = []
        for g in groups.values():
            if len(g) == 1 and level:
                up.append(g[0])
                continue
            node = hashlib.sha256("".join(d for _, d in g).encode()).hexdigest()
            out.add((level, node, g[-1][0], len(g)))
            up.append((g[-1][0], node))
        items, level = up, level + 1
        if len(items) == 1:
            return out


def test_directory_levels(spark):
    dirs = {f"d{i}": [f"n{j:04d}" for j in range(n)] for i, n in enumerate((1, 2, 17, 300))}
    df = spark.createDataFrame([(d, n) for d, ns in dirs.items() for n in ns], "directory string, name string").withColumn("digest", F.sha2("name", 256))
    got = tree.directory_levels(df, 2).collect()
    for d, names in dirs.items():
        assert {(r.level, r.node, r.sep_name, r.n_children) for r in got if r.directory == d} == brute_levels(names, 2)


@pytest.mark.parametrize("limit", [1, 7, 100, 999, 1000, 5000])
def test_pages(spark, limit):
    names = [f"{i:04d}" for i in range(1000)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    rows = tree.page(df, "0099", limit).collect()
    assert [r.name for r in rows] == names[100 : 100 + limit] and {r.more for r in rows} == {100 + limit < 1000}
    with pytest.raises(ValueError, match="positive"):
        tree.page(df, None, 0)


def test_graph(spark):
    e = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("q", "d")], "parent string, child string")
    roots = spark.createDataFrame([("r",)], "node string")
    assert sorted(r.node for r in graph.closure(roots, e).collect()) == list("abcdr")
    have = spark.createDataFrame([("r",), ("a",), ("b",), ("d",)], "node string")
    assert [r.node for r in graph.missing(roots, e, have).collect()] == ["c"]
    why = graph.why(spark.createDataFrame([("d",), ("b",)], "node string"), e, spark.createDataFrame([("one", "r"), ("two", "q")], "name string, node string"))
    assert sorted(map(tuple, why.collect())) == [("b", "one"), ("d", "one"), ("d", "two")]
    assert graph.closure(roots.where("false"), e).count() == 0


def test_deep_graphs_and_leaves(spark):
    """A chain deeper than any fixed bound of rounds that is kept in pieces, and leaves that never meet the edges."""
    n = 40
    e = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(n)] + [("leaf", "n00"), ("n40", "leaf")], "parent string, child string")
    roots = spark.createDataFrame([("n00",)], "node string")
    assert sorted(r.node for r in graph.closure(roots, e, leaf="node = 'leaf'").collect()) == ["leaf"] + [f"n{i:02d}" for i in range(n + 1)]
    assert len(graph.closure(roots, e).collect()) == n + 2  # a cycle ends


def test_pull_is_one_walk(spark, monkeypatch):
    """Rounds of a random graph with cycles, repeated edges, nulls and leaves; the edges are written once, and no leaf's."""
    rng, names = random.Random(5), [f"n{i}" for i in range(40)] + [f"leaf{i}" for i in range(60)]
    pairs = [(rng.choice(names[:40]), rng.choice(names)) for _ in range(160)] + [(f"c{i}", f"c{i + 1}") for i in range(18)]
    pairs += pairs[:5] + [("n0", "c0"), (None, "n1"), ("n1", None)]
    have = [x for x in names if rng.random() < 0.5] + [f"c{i}" for i in range(0, 19, 2)]
    roots = ["n0", "n1", "leaf0", "leaf1", None]
    best = {x: int(x not in have) for x in roots if x}
    for _ in range(300):
        for p, c in pairs:
            if p in best and c:
                best[c] = min(best.get(c, 999), best[p] + (c not in have))
    tables = []
    monkeypatch.setattr(graph, "written", lambda df, name, f=graph.written: tables.append((name, t := f(df, name))) or t)
    count = []
    monkeypatch.setattr(graph, "discard", lambda *t: count.append(t[0].count()))
    frame = lambda rows, ddl: spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ddl)
    got = graph.pull(frame(roots, "node string"), frame(pairs, "parent string, child string"), frame(have, "node string"), leaf="node LIKE 'leaf%'").collect()
    want = {x: k for x, k in best.items() if x not in have}
    assert max(want.values()) > 8 and any(x.startswith("leaf") for x in want)
    assert len(got) == len(want) and {r.node: r["round"] for r in got} == want
    assert [name for name, _ in tables].count("edges") == 1
    assert count == [sum(1 for p, c in pairs if p and c and not c.startswith("leaf"))]


def test_pull_and_gate(spark):
    e = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("q", "d")], "parent string, child string")
    have = spark.createDataFrame([("r",), ("b",), ("d",), ("q",)], "node string")
    roots = spark.createDataFrame([("one", "r"), ("two", "q")], "name string, node string")
    assert sorted(map(tuple, graph.pull(roots, e, have).collect())) == [("a", 1), ("c", 1)]
    assert sorted(map(tuple, graph.pull(roots, e, have.where("node <> 'b'")).collect())) == [("a", 1), ("b", 1), ("c", 2)]
    assert graph.pull(roots.where("name = 'two'"), e, have).count() == 0
    assert sorted(map(tuple, graph.gate(roots, e, have).select("name", "n_missing", "complete").collect())) == [("one", 2, False), ("two", 0, True)]


def test_resolve(spark):
    entries = spark.createDataFrame([("", "a", "/a", True), ("/a", "b", "/a/b", True), ("/a/b", "f", "file", False), ("/a", "é", "x", False)], "parent string, name string, child string, is_dir boolean")
    paths = ["a/b/f", "/a//b/./f/", "", "/", "a/b/c/nope", "a/b/f/x/y", "..", "a/../a", "a/é", "b", None]
    df = spark.createDataFrame(list(enumerate(paths)), "id int, path string").select("id", F.lit("").alias("start"), S.path_parts(F.col("path")).alias("parts"))
    got = {r.id: (r.node, r.outcome) for r in tree.resolve(df, entries).collect()}
    assert [got[i] for i in range(len(paths))] == [("file", "ok"), ("file", "ok"), ("", "ok"), ("", "ok"), (None, "missing"), (None, "not_a_directory"), (None, "path"), (None, "path"), ("x", "ok"), (None, "missing"), (None, "path")]
    assert [r.outcome for r in tree.resolve(df.where("id < 2").withColumn("start", F.lit(None).cast("string")), entries).collect()] == ["missing", "missing"]
    assert tree.resolve(df.where("false"), entries).count() == 0


def test_lookup(spark):
    names = [f"n{i:03d}" for i in range(0, 200, 2)]
    entries = spark.createDataFrame([(d, n) for d in ("x", "y") for n in names], "directory string, name string").withColumn("digest", F.sha2("name", 256))
    probes = spark.createDataFrame([(d, f"n{i:03d}") for d in ("x", "z") for i in range(0, 203)] * 2, "directory string, name string")
    leaves = tree.leaf_runs(entries, 2)
    seps = sorted(r.sep_name for r in leaves.where("directory = 'x'").collect())
    got = {(r.directory, r.name): (r.sep_name, r.found) for r in tree.lookup(probes, leaves, entries).collect()}
    assert got == {(d, f"n{i:03d}"): (next((s for s in seps if s >= f"n{i:03d}"), None) if d == "x" else None, d == "x" and f"n{i:03d}" in names) for d in ("x", "z") for i in range(203)}


def test_newest_copy_is_by_number(spark):
    df = spark.createDataFrame([("k", 9, 1), ("k", 10, 2), ("j", 2, 3)], "key string, segment_id long, off long")
    assert {r.key: r.segment_id for r in store.newest_copies(df).collect()} == {"k": 10, "j": 2}
    with pytest.raises(TypeError, match="numbers"):
        store.newest_copies(df.withColumn("segment_id", F.col("segment_id").cast("string")))
    w = spark.createDataFrame([("b", 0), ("b", 1), ("a", 0), ("a", 2)], "writer string, n long")
    assert sorted((r.writer, r.n, r.id) for r in store.number_segments(w, "writer", "n", "id").collect()) == [("a", 0, 0), ("a", 2, 2), ("b", 0, 3), ("b", 1, 4)]


def test_segments_that_end_badly(spark):
    rows = [(1, "a", 8, 10, True), (1, "b", 64, 10, False), (1, "c", 120, 10, True), (2, "d", 8, 4, True)]
    df = spark.createDataFrame(rows, "segment_id long, key string, off long, slen long, good boolean")
    assert sorted(r.key for r in store.valid_prefix(df).collect()) == ["a", "d"]
    index = spark.createDataFrame([(1, "a", 8), (1, "b", 65), (2, "d", 8)], "segment_id long, key string, at long")
    bodies = spark.createDataFrame([(1, 176), (2, 60)], "segment_id long, body long")
    assert sorted(map(tuple, store.scrub(df, index, bodies).collect())) == [(1, 3, 2, True), (2, 1, 0, False)]
    s = spark.createDataFrame([(1, True, 5), (2, True, 6), (3, False, None)], "segment_id long, sealed boolean, sealed_at long")
    assert [r.eligible for r in store.eligible(s, 5).orderBy("segment_id").collect()] == [True, False, False]
    assert [r.eligible for r in store.eligible(s, None).collect()] == [False] * 3


def test_compaction_keeps_what_lives(spark):
    rows = [(f"k{i}", 10 * i, i % 4) for i in range(40)] + [("k1", 10, 3), ("k8", 80, 1)]
    records = spark.createDataFrame(rows, "key string, slen long, segment_id long")
    live = spark.createDataFrame([(f"k{i}",) for i in range(0, 40, 4)] + [("k1",)], "key string")
    grey = spark.createDataFrame([("k2",)], "key string")
    for ratio in (0.0, 0.3, 0.9):
        after, chosen = store.compact(records, live, grey, ratio, 9)
        kept = {r.key for r in after.collect()}
        assert {f"k{i}" for i in range(0, 40, 4)} | {"k1", "k2"} <= kept
        gone = {r.segment_id for r in chosen.collect()}
        assert not gone & {r.segment_id for r in after.collect()}
    assert [store.selection_ratio(*x) for x in ((None, 0.5), (None, 0.01), (0.0, 0.01), (-1, 0.5))] == [0.5, 0.1, 0.0, 0.5]


def ignored(spark, lines, paths):
    df = spark.createDataFrame([(p.rstrip("/"), p.endswith("/")) for p in paths], "path string, is_dir boolean")
    rules = ignore.parse(lines)
    return [r.path for r in df.withColumn("x", ignore.ignored(F.col("path"), F.col("is_dir"), rules)).where("x").collect()]


def test_ignore(spark):
    assert ignored(spark, [("", "*.log"), ("", "!keep.log")], ["a.log", "d/b.log", "keep.log", "a.txt"]) == ["a.log", "d/b.log"]
    assert ignored(spark, [("", "/top")], ["top", "d/top", "top/x"]) == ["top", "top/x"]
    assert ignored(spark, [("", "build/")], ["build/", "build/a", "x/build/", "y/build"]) == ["build", "build/a", "x/build"]
    assert ignored(spark, [("", "a/**/z")], ["a/z", "a/b/z", "a/b/c/z", "b/z"]) == ["a/z", "a/b/z", "a/b/c/z"]
    assert ignored(spark, [("d", "*.x\r"), ("", "# no"), ("", " ")], ["d/e/f.x", "f.x"]) == ["d/e/f.x"]
    assert ignored(spark, [("", "*")], [".ignore", "a", ".ignore/"]) == ["a", ".ignore"]
    assert ignored(spark, [("", "d/"), ("", "!d/a")], ["d/", "d/a"]) == ["d", "d/a"]
    assert ignored(spark, [("", "[!a-c]?")], ["ax", "dx", "d"]) == ["dx"]


def test_rights(spark):
    lines = ["# c", "", "ssh-ed25519 AAAA me", 'caps="read,admin" ssh-rsa BBBB', 'caps="fly" ssh-rsa CCCC', "ssh-rsa BBBB x"]
    df = spark.createDataFrame(list(enumerate(lines)), "pos int, value string")
    got = {r.key: r.caps for r in refs.allow_list(df).collect()}
    assert got == {"ssh-ed25519 AAAA": ["read", "push-objects", "write-refs"], "ssh-rsa BBBB": ["read", "push-objects", "write-refs"], "ssh-rsa CCCC": None}


def test_names_sizes_and_trailers(spark):
    row = spark.sql("SELECT 1").select(
        S.name_error(F.unhex(F.lit("ff6162")).cast("string")).alias("bytes"), S.name_error(F.lit("é" * 513)).alias("long"), S.name_error(F.lit("a@b")).alias("at"), S.name_error(F.lit("a@b"), allow_at=True).alias("user"), S.name_error(F.lit("a\x85")).alias("control"),
        S.promoted_size(F.lit(1048524)).alias("below"), S.promoted_size(F.lit(1048525)).alias("above"), S.promoted_size(F.lit(1023)).alias("bytes_"), S.base_name(F.lit("/a/b//")).alias("base"), S.shell_quoted(F.lit("it's")).alias("quoted"), S.shell_quoted(F.lit("")).alias("empty"),
        S.segment_number(F.lit("ffffffffffffffff.seg")).alias("most"), S.segment_number(F.lit("1.seg")).alias("short"), S.view_mode(F.lit(b'{"a": 1}')).alias("json"), S.view_mode(F.lit(b"{a")).alias("text"), S.view_mode(F.lit(b"\x00")).alias("hex"),
        S.media_type(F.lit("a.JSON"), F.lit(b"")).alias("by_name"), S.media_type(F.lit("a"), F.unhex(F.lit("ffd8ff00"))).alias("by_bytes"), *[x.alias(f"trailer{i}") for i, x in enumerate(S.trailer_parts(F.lit(b"bodysig\x00\x00\x00\x03")))], *[x.alias(f"bad{i}") for i, x in enumerate(S.trailer_parts(F.lit(b"\x00\x00\x00\x01")))],
    ).first()
    assert (row.bytes, row.long, row.at, row.user, row.control) == ("encoding", "length", "at", None, "control")
    assert (row.below, row.above, row.bytes_) == ("1023.9 KiB", "1.0 MiB", "1023 B") and (row.base, row.quoted, row.empty) == ("b", "'it'\\''s'", "''")
    assert row.most == 2**64 - 1 and row.short is None and (row.json, row.text, row.hex) == ("json", "text", "hex")
    assert (row.by_name, row.by_bytes) == ("application/json", "image/jpeg") and (bytes(row.trailer0), row.trailer1, row.bad0, row.bad1) == (b"body", "sig", None, None)


def test_attribute_sizes(spark):
    from arborlake.functions import codec

    rows = [{}, {b"a": b""}, {b"k" * 23: b"v" * 24}, {b"x": b"y" * 300, b"z" * 256: b"q"}]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id int, a map<binary,binary>")
    assert {r.id: r.n for r in df.select("id", S.attributes_size(F.col("a")).alias("n")).collect()} == {i: len(codec.encode(x)) for i, x in enumerate(rows)}


def test_authorisation(spark):
    allowed = spark.createDataFrame([("a", ["admin"]), ("d", ["delegate"]), ("r", ["read"])], "key string, caps array<string>")
    asked = spark.createDataFrame([("a", "wipe", None, None), ("x", "read", "d", ["read"]), ("x", "read", "r", ["read"]), ("x", "write-refs", "a", ["write-refs"]), ("r", "push-objects", "d", ["read"]), (None, "read", None, None)], "key string, cap string, issuer string, granted array<string>")
    assert sorted((str(r.key), r.cap, str(r.issuer), r.outcome) for r in refs.authorise(asked, allowed).collect()) == [("None", "read", "None", "denied"), ("a", "wipe", "None", "own"), ("r", "push-objects", "d", "denied"), ("x", "read", "d", "grant"), ("x", "read", "r", "denied"), ("x", "write-refs", "a", "denied")]
    remotes = spark.createDataFrame([(1, "o", "u1"), (2, "p", "u2"), (2, "q", "u3")], "owner int, name string, url string")
    wanted = spark.createDataFrame([(1, None), (2, None), (2, "q"), (3, None), (1, "z")], "owner int, name string")
    assert sorted((r.owner, str(r.name), r.outcome) for r in refs.resolve_remote(wanted, remotes).collect()) == [(1, "None", "ok"), (1, "z", "missing"), (2, "None", "ambiguous"), (2, "q", "ok"), (3, "None", "missing")]


def test_scalars(spark):
    row = spark.sql("SELECT 1").select(
        S.show_time(F.lit(10**18), F.lit(10**18 + 10**15)).alias("near"), S.show_time(F.lit(10**18), F.lit(3 * 10**18)).alias("far"), S.rfc3339_ns(F.lit(10**18 + 120)).alias("ns"), S.rfc3339_ns(F.lit(10**18)).alias("s"),
        S.hex_dump(F.lit(b"0123456789abcdef\x00z")).alias("dump"), S.path_parts(F.lit("/a//./b/")).alias("parts"), S.path_parts(F.lit("a/../b")).alias("up"), S.unsafe_name(F.lit("a/b")).alias("unsafe"),
        K.split_key_list(F.lit("ab" * 64)).alias("keys"), K.split_key_list(F.lit("ab")).alias("bad"), S.is_textual(F.lit("é" * 5000).cast("binary")).alias("cut"), S.is_textual(F.lit(b"a\x00b")).alias("nul"),
        K.key_error(F.lit(None).cast("string")).alias("none"), K.key_length(K.key_hex(0, F.lit(0), F.sha2(F.lit(""), 256))).alias("zero"),
    ).first()
    assert row.near == "Sep 09 01:46" and row.far == "Sep 09  2001" and row.ns == "2001-09-09T01:46:40.00000012Z" and row.s == "2001-09-09T01:46:40Z"
    assert row.dump == ["00000000  30 31 32 33 34 35 36 37 38 39 61 62 63 64 65 66  |0123456789abcdef|", "00000010  00 7a" + " " * 42 + "  |.z|"]
    assert row.parts == ["a", "b"] and row.up is None and row.unsafe and len(row.keys) == 2 and row.bad is None and row.cut and not row.nul and row.none == "size" and row.zero == 0
