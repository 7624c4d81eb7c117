"""Jaccard self-join of documents on word n-grams, by vertical partitioning.

A document is its set of distinct n-grams, hashed to 64 bits; equal sets are one
node.  The global n-gram order is by frequency, rare n-grams first, then by hash;
frequencies come from a table of a fixed number of counters over all documents
(n-grams that share a counter only make the order less sharp, never wrong).

Candidates.  Linked sets share an n-gram of their first fragments: of a set of
``s`` n-grams, the first ``s - ceil(t s) + 1`` in the order.  Since these are its
rarest, a passage that many documents share brings documents together only
where it makes up all but that part of them.

Counting.  The order of hashes is cut into a few wide fragments; each candidate
pair's overlap is counted in every fragment separately and the partial overlaps
are summed per pair, which decides the link.

Links inside a group of near copies are not all visited.  First each node is
compared with the lead of the n-grams it shares most, the node that has the
n-gram earliest in its order.  Then, in passes, each component picks the closest
pairs that may link it to another component of an n-gram: pairs whose sizes and
places in the order allow a link, and whose parity sketches, which grow with the
set, differ in no more bits than linked sets may.  Those not tested before are
counted, and components merge.  A pass takes 16 times as many pairs for each
component as the one before, and looks only where the one before left some out,
so the passes end when every pair that may link two components has been tested,
and no link that could join two components is lost.  Nodes outside an n-gram's
main component meet its nodes in blocks, so no task holds all nodes of an n-gram.

Null or wordless text: an empty set, linked with nothing.  Rows with one id count
as one document, linked if any of them is, whatever their texts.  Rows with a
null id link like others, but never name a component: it is null where no row of
it has an id.  Repeated rows are equal sets.  Columns that clash with those made
here are replaced; others keep their names.  An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, frugal, read_table, small, widened
from .components import components
from .wordarrays import mix, normalized, window_hashes, word_ends, word_hashes

CHUNK = 1 << 21
WIDE = 4
#: Counters of the frequency table, in blocks, and the smallest parity sketch in 64-bit words.
COUNTERS, COUNTER_BLOCK = 20, 16
SKETCH_WORDS = 8
#: Nodes of an n-gram that one task compares at once, and up to which it does so without sketches.
BLOCK, FEW = 4096, 32


def document_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    parts = [normalized(t.lower()) if t else np.zeros(0, np.uint8) for t in texts]
    norm = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    ends = word_ends(norm)
    h = word_hashes(norm, ends)
    grams = window_hashes(h, n)
    last = np.searchsorted(ends, np.cumsum([len(p) for p in parts])).tolist()
    first = 0
    for end in last:
        words = end - first
        if words >= n:
            yield np.unique(grams[first : end - n + 1])
        elif words:
            yield window_hashes(h[first:end], words) ^ np.uint64(words)
        else:
            yield np.zeros(0, np.uint64)
        first = end


def most_different(percent: int, n1, n2):
    """Largest symmetric difference of linked sets of these sizes."""
    total = n1 + n2
    return total - 2 * -(-percent * total // (100 + percent))


def first_fragment(percent: int, n: int) -> int:
    """Length of the fragment in which a set of n n-grams shares one with every set it links with."""
    return n - -(-percent * n // 100) + 1 if n else 0


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set's elements by hash: sketches differ in at most as many bits as sets do in elements."""
    bits = max(64 * SKETCH_WORDS, 1 << (len(s) - 1).bit_length()) if len(s) else 64 * SKETCH_WORDS
    odd = np.bincount((mix(s) >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) brought down to a smaller power of two."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _by_chunks(batches: Iterator[pa.RecordBatch], column: int, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        start = size = 0
        col = batch.column(column)
        texts: list[bytes] = []
        for i in range(len(batch)):
            texts.append((col[i].as_py() or "").encode())
            size += len(texts[-1])
            if size >= CHUNK or i == len(batch) - 1:
                yield batch.slice(start, i + 1 - start), list(document_sets(texts, n))
                start, size, texts = i + 1, 0, []


def frequency_classes(texts: DataFrame, n: int) -> np.ndarray:
    """A class (a fourth of a power of two) for each counter of n-gram hashes, over all rows of a one-column table.

    A task sends its counters in compressed blocks, which are added up in two
    levels as they stream by; what reaches the driver has a fixed size.
    """
    size = 1 << COUNTER_BLOCK

    def block(k: int, fan: int, c: np.ndarray) -> pa.RecordBatch:
        blob = zstandard.ZstdCompressor(level=1).compress(c.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([fan], pa.int32()), pa.array([blob], pa.binary())], names=["block", "fan", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, total = np.zeros(1 << COUNTERS, np.uint32), [], 0

        def add() -> None:
            u, c = np.unique((np.concatenate(waiting) >> np.uint64(64 - COUNTERS)).astype(np.uint32), return_counts=True)
            held[u] += c.astype(np.uint32)

        for _, sets in _by_chunks(batches, 0, n):
            waiting += sets
            total += sum(map(len, sets))
            if total > 1 << 21:
                add()
                waiting, total = [], 0
        if total:
            add()
        for k in range(len(held) // size):
            part = held[k * size : (k + 1) * size]
            if part.any():
                yield block(k, TaskContext.get().partitionId(), part.astype(np.int64))

    def summed(last: bool):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, total = None, None
            unpack = zstandard.ZstdDecompressor().decompress
            # the last level gives classes: a fourth of a power of two
            done = lambda: block(*now, np.minimum(np.log2(total + 1) * 4, 255).astype(np.uint8) if last else total)
            for b in batches:
                for k, fan, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    if (k, fan) != now:
                        if now is not None:
                            yield done()
                        now, total = (k, fan), np.zeros(size, np.int64)
                    total += np.frombuffer(unpack(c.as_py()), np.int64)
            if now is not None:
                yield done()

        return add

    kind = "block int, fan int, counts binary"
    fan = max(1, int(texts.rdd.getNumPartitions() ** 0.5))
    sent = texts.mapInArrow(frugal(count), kind).withColumn("fan", (F.col("fan") % fan).cast("int"))
    sent = sent.repartition("block", "fan").sortWithinPartitions("block", "fan").mapInArrow(frugal(summed(False)), kind)
    sent = sent.withColumn("fan", F.lit(0)).repartition("block").sortWithinPartitions("block").mapInArrow(frugal(summed(True)), kind)
    out = np.zeros(1 << COUNTERS, np.uint8)
    unpack = zstandard.ZstdDecompressor().decompress
    for r in sent.toLocalIterator():  # at most 16 blocks of a byte for each counter
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(unpack(r["counts"]), np.uint8)
    return out


def describe(docs: DataFrame, classes: np.ndarray, n: int, percent: int) -> DataFrame:
    """All columns but the last, the text, plus ``size, print1, print2, sketch, prefix`` of each document's set."""
    schema = widened(docs.drop(docs.columns[-1]).schema, "size bigint, print1 bigint, print2 bigint, sketch binary, short binary, prefix array<bigint>")
    shared = docs.sparkSession.sparkContext.broadcast(classes)
    low, at = np.uint64((1 << 56) - 1), len(docs.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch, sets in _by_chunks(batches, at, n):
            prefix = []
            for s in sets:
                order = np.argsort((table[s >> np.uint64(64 - COUNTERS)].astype(np.uint64) << np.uint64(56)) | (s & low), kind="stable")
                prefix.append(s[order[: first_fragment(percent, len(s))]].view(np.int64))
            mixed = [mix(s) for s in sets]
            arrays = [*batch.columns[:-1], pa.array([len(s) for s in sets], pa.int64())]
            arrays += [pa.array(np.array([x.sum(dtype=np.uint64) for x in mixed], np.uint64).view(np.int64))]
            arrays += [pa.array(np.array([mix(x + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for x in mixed], np.uint64).view(np.int64))]
            sketches = [sketch(s) for s in sets]
            arrays += [pa.array(sketches, pa.binary()), pa.array([folded(np.frombuffer(x, np.uint64)[None, :], SKETCH_WORDS).tobytes() for x in sketches], pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(frugal(run), schema)


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """Rows ``sig, node, size, place, lead`` of the n-grams that the first fragments of at least two nodes have."""
    rows = nodes.select("node", "size", F.posexplode("prefix").alias("place", "sig"))
    # one row a task for an n-gram, whatever the number of its nodes
    met = cut(rows.groupBy("sig").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("sig"), "met")
    rows = cut(rows.join(small(met), "sig").select("sig", "node", "size", "place"), "rows")
    leads = cut(rows.groupBy("sig").agg(F.min_by("node", F.struct("place", "node")).alias("lead")), "leads")
    out = cut(rows.join(small(leads), "sig").select("sig", "node", "size", "place", "lead"), "buckets")
    drop(met, rows, leads)
    return out


def count_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows ``a, b, n1, n2`` of ``pairs`` whose sets link, by partial overlaps in every wide fragment."""

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(3), b.column(4)
            found = [len(np.intersect1d(np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64), assume_unique=True)) for i in range(len(b))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.int64())], names=["a", "b", "fragment", "overlap"])

    one = sets.select(F.col("node").alias("b"), "fragment", F.col("part").alias("y"))
    two = sets.select(F.col("node").alias("a"), "fragment", F.col("part").alias("x"))
    # while the pairs are few, only the sets they name are shuffled
    two = two.join(small(cut(pairs.select("a").distinct(), "leads")), "a", "left_semi")
    wide = one.join(small(pairs.select("a", "b")), "b").join(two, ["a", "fragment"]).select("a", "b", "fragment", "x", "y")
    partial = wide.mapInArrow(frugal(overlap), "a long, b long, fragment int, overlap long")
    total = partial.groupBy("a", "b", "fragment").agg(F.max("overlap").alias("overlap")).groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    return total.join(pairs, ["a", "b"]).where(F.col("overlap") * (100 + percent) >= percent * (F.col("n1") + F.col("n2"))).select("a", "b")


def write_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Rows ``node, fragment, part`` for the nodes of ``wanted`` (node, print1, id, hash), read from the rows of ``docs``
    (id, hash, text) that represent them."""
    w = wanted.select("node", "print1", F.col("id").alias("w_id"), F.col("hash").alias("w_hash"))
    chosen = docs.join(w, (F.col("hash") == F.col("w_hash")) & F.col("id").eqNullSafe(F.col("w_id"))).select("node", "text", "print1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # a node that several equal rows stand for is written once a task
        for batch, sets in _by_chunks(batches, 1, n):
            node, fragment, part = [], [], []
            for v, want, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), sets, strict=True):
                if v not in done and int(mix(s).sum(dtype=np.uint64).view(np.int64)) == want:
                    done.add(v)
                    f = (s >> np.uint64(62)).astype(np.int64)
                    at = np.searchsorted(f, np.arange(WIDE + 1))
                    for i in range(WIDE):
                        if at[i + 1] > at[i]:
                            node.append(v)
                            fragment.append(i)
                            part.append(s[at[i] : at[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(fragment, pa.int32()), pa.array(part, pa.binary())], names=["node", "fragment", "part"])

    return cut(chosen.mapInArrow(frugal(run), "node long, fragment int, part binary"), "sets")


class Side:
    """Nodes of one n-gram: node, component, size, place in the node's order, and short sketch (null for few nodes)."""

    def __init__(self, rows: pa.Table):
        self.node, self.comp, self.size, self.place = (rows.column(c).to_numpy() for c in ("node", "comp", "size", "place"))
        blobs = rows.column("short").to_pylist()
        self.short = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, SKETCH_WORDS) if blobs and blobs[0] is not None else None


def nearest_partners(probe: Side, members: Side, percent: int, k: int) -> list[np.ndarray]:
    """For each component of ``probe`` the k closest pairs that may link it to another component's member.

    Columns comp, a, b, n1, n2, differ, more (1 where the component has further
    pairs here).  In the first n-gram that linked sets share, what follows it in
    both must hold the rest of their overlap.  Closeness is the difference of the
    short sketches, which linked sets' difference bounds, or what precedes the
    n-gram in both, which differs if it is the first that they share.
    """
    found: list[np.ndarray] = [np.zeros((0, 6), np.int64)]
    step = max(1, (1 << 19) // max(1, len(members.node)))
    n2 = members.size[None, :]
    for lo in range(0, len(probe.node), step):
        i = slice(lo, lo + step)
        n1 = probe.size[i][:, None]
        rest = np.minimum(n1 - probe.place[i][:, None], n2 - members.place[None, :])
        ok = (probe.comp[i][:, None] != members.comp[None, :]) & (percent * np.maximum(n1, n2) <= 100 * np.minimum(n1, n2)) & (rest * (100 + percent) >= percent * (n1 + n2))
        x, y = np.nonzero(ok)
        x += lo
        if probe.short is None or members.short is None:  # what lies before the place in either set differs
            differ = probe.place[x] + members.place[y]
        else:
            differ = np.bitwise_count(probe.short[x] ^ members.short[y]).sum(axis=1).astype(np.int64)
        good = differ <= most_different(percent, probe.size[x], members.size[y])
        x, y, differ = x[good], y[good], differ[good]
        a, b, m1, m2 = probe.node[x], members.node[y], probe.size[x], members.size[y]
        swap = a > b
        found.append(np.column_stack([probe.comp[x], np.where(swap, b, a), np.where(swap, a, b), np.where(swap, m2, m1), np.where(swap, m1, m2), differ]))
    t = np.concatenate(found)
    t = t[np.lexsort((t[:, 2], t[:, 1], t[:, 5], t[:, 0]))]
    head = np.flatnonzero(np.concatenate([[True], t[1:, 0] != t[:-1, 0]])) if len(t) else np.zeros(0, np.int64)
    each = np.diff(np.append(head, len(t)))
    place = np.arange(len(t)) - np.repeat(head, each)
    kept = place < k
    return [*t[kept].T, np.repeat(each > k, each)[kept].astype(np.int64)]


def candidates(members: DataFrame, shorts: DataFrame, percent: int, k: int) -> DataFrame:
    """Rows ``sig, comp, a, b, n1, n2, differ, more`` of every n-gram (``sig, node, comp, size, place``; shorts: ``node, short``).

    The nodes outside an n-gram's main component, in blocks, meet all its nodes,
    in blocks; a pair of blocks is a group, so a group has at most two blocks.
    Where one block holds all, its rows travel once, and where they are few,
    without sketches: their pairs are few as well.
    """
    names = ["sig", "comp", "a", "b", "n1", "n2", "differ", "more"]
    groups = ["sig", "one", "two"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            key = np.column_stack([t.column(c).to_numpy() for c in groups])
            side = t.column("side").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                m = i + int((side[i:j] > 0).sum())  # the probes come first
                first = i if side[i] == 2 else m
                x = nearest_partners(Side(t.slice(i, m - i)), Side(t.slice(first, j - first)), percent, k)
                for o, v in zip(out, [np.full(len(x[0]), key[i, 0]), *x], strict=True):
                    o.append(v)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=names)

        for b in batches:
            if not len(b):
                continue
            # all groups that have ended are done together; the last may go on in the next batch
            key = np.column_stack([b.column(i).to_numpy() for i in range(3)])
            start = int(np.argmax((key == key[-1]).all(axis=1)))
            if held and [c[0].as_py() for c in held[-1].columns[:3]] != key[0].tolist():
                yield done(pa.Table.from_batches(held))
                held = []
            if start:
                yield done(pa.Table.from_batches([*held, b.slice(0, start)]))
                held = []
            held.append(b.slice(start))
        if held:
            yield done(pa.Table.from_batches(held))

    count = members.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("n"))
    count = count.groupBy("sig").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    blocks = count.select("sig", "main", F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("ones"), F.ceil(F.col("all") / BLOCK).alias("twos"), F.col("all").alias("total"))
    m = members.join(blocks, "sig")
    few, alone, outside = F.col("total") <= FEW, F.col("twos") == 1, F.col("comp") != F.col("main")
    block = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    row = ["node", "comp", "size", "place", "short"]
    side = F.when(outside, 2).otherwise(0).alias("side")
    light = m.where(few).select("sig", F.lit(0).alias("one"), F.lit(0).alias("two"), side, *row[:4], F.lit(None).cast("binary").alias("short"))
    m = m.where(~few).join(shorts, "node")
    once = m.where(alone).select("sig", F.lit(0).alias("one"), F.lit(0).alias("two"), side, *row)
    probe = m.where(~alone & outside).select("sig", block(1, "ones").alias("one"), every("twos").alias("two"), F.lit(1).alias("side"), *row)
    rest = m.where(~alone).select("sig", every("ones").alias("one"), block(2, "twos").alias("two"), F.lit(0).alias("side"), *row)
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = light.unionByName(once).unionByName(probe).unionByName(rest).repartition(tasks, *groups).sortWithinPartitions(*groups, F.desc("side"))
    return dealt.mapInArrow(frugal(run), ", ".join(f"{n} long" for n in names))


def near_enough(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches do not rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y, n1, n2 in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = min(len(x), len(y)) // 8
                differ = np.bitwise_count(folded(np.frombuffer(x, np.uint64)[None, :], words) ^ folded(np.frombuffer(y, np.uint64)[None, :], words)).sum()
                good.append(int(differ) <= most_different(percent, n1, n2))
            yield b.select(["a", "b", "n1", "n2"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
    return both.select("a", "b", "n1", "n2", "x", "y").mapInArrow(frugal(run), "a long, b long, n1 long, n2 long")


def links_of(docs: DataFrame, nodes: DataFrame, buckets: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows ``a, b``: links between nodes, enough to have the same components as all links."""
    about = cut(nodes.join(small(cut(buckets.select("node").distinct(), "in_buckets")), "node", "left_semi").select("node", "print1", "id", "hash", "sketch", "short"), "about")
    sets = write_sets(docs, about.select("node", "print1", "id", "hash"), n)
    shorts = small(about.select("node", "short"), binary=8 * SKETCH_WORDS)
    # first, each node with the lead of the n-grams that it shares most
    sizes = buckets.select(F.col("node").alias("a"), F.col("size").alias("n1")).distinct()
    best = buckets.where("lead <> node").groupBy("node", "size", "lead").count().groupBy(F.col("node").alias("b"), F.col("size").alias("n2")).agg(F.max_by("lead", F.struct("count", -F.col("lead"))).alias("a"))
    pairs = best.join(sizes, "a").where(f"{percent} * greatest(n1, n2) <= 100 * least(n1, n2)")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("n1")).otherwise(F.col("n2")).alias("n1"), F.when(F.col("a") < F.col("b"), F.col("n2")).otherwise(F.col("n1")).alias("n2"))
    pairs = cut(pairs.distinct(), "pairs")
    links = cut(count_links(pairs, sets, percent), "links")
    found = components(links)

    tested, left, k = pairs.select("a", "b"), buckets, 16
    while True:
        members = left.join(found.select("node", F.col("component").alias("comp")), "node", "left").select("sig", "node", "size", "place", F.coalesce("comp", "node").alias("comp"))
        unsettled = members.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("sig")
        members = cut(members.join(unsettled, "sig", "left_semi"), "members")
        near = cut(candidates(members, shorts, percent, k), "near")
        drop(members)
        each = near.groupBy("comp", "a", "b", "n1", "n2").agg(F.min("differ").alias("differ"))
        picks = each.withColumn("nth", F.row_number().over(Window.partitionBy("comp").orderBy("differ", "a", "b"))).where(F.col("nth") <= k + 1)
        picks = cut(picks, "picks")
        pairs = cut(picks.where(F.col("nth") <= k).select("a", "b", "n1", "n2").distinct().join(small(tested), ["a", "b"], "left_anti"), "pairs")
        tested = cut(tested.unionByName(pairs.select("a", "b")), "tested")
        more = cut(count_links(cut(near_enough(pairs, about, percent), "pairs"), sets, percent), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            found = components(links)
        # only where k cut something off is there more to test
        over = picks.where(F.col("nth") == k + 1).select("comp").distinct()
        open_ = near.where("more = 1").select("sig").unionByName(near.join(over, "comp", "left_semi").select("sig")).distinct()
        still = cut(left.join(open_, "sig", "left_semi"), "buckets")
        drop(near, picks)
        if left is not buckets:
            drop(left)
        left, k = still, 16 * k
        if left.isEmpty():
            break
    drop(sets, about, left)
    return links


def link_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` without its text, plus ``n_shingles``, ``component_id`` (the smallest id reachable by links) and
    ``leads_group``: true for one row of each group that links alone hold together, that of its smallest id."""
    made = ("n_shingles", "component_id", "leads_group")
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), *made)]
    own = [f"rest{k}" for k in range(len(rest))]
    body = F.col(f"`{text}`").cast("string")
    src = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(rest, own, strict=True)], F.col(f"`{id_column}`").cast("long").alias("id"), F.xxhash64(body).alias("hash"), body.alias("text"))

    described = describe(src, frequency_classes(src.select("text"), n), n, percent)
    described = cut(described.withColumn("row", F.monotonically_increasing_id()), "described")
    prints = ["size", "print1", "print2"]
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row", "hash"))
    nodes = described.where("size > 0").groupBy(*prints).agg(first.alias("first"), F.any_value("sketch").alias("sketch"), F.any_value("short").alias("short"), F.any_value("prefix").alias("prefix"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), *prints, "first.id", "first.row", "first.hash", "sketch", "short", "prefix"), "nodes")
    buckets = shared_buckets(nodes)
    links = links_of(src.select("id", "hash", "text"), nodes, buckets, n, percent)
    found = components(links)

    # groups by links alone, each with its first row
    grouped = nodes.select("node", *prints, "id", "row").join(found, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    lead = grouped.groupBy("group").agg(F.min("id").alias("least"), F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias("lead"))
    # ids with several rows join the groups of these
    again = described.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    of = cut(described.select("id", *prints).join(again, "id", "left_semi").distinct().join(grouped.select(*prints, "group"), prints).select("id", "group").distinct(), "named")
    named = of.groupBy("id").agg(F.min("group").alias("first"))
    merged = components(of.join(named, "id").select(F.col("first").alias("a"), F.col("group").alias("b")))
    lead = cut(lead.join(merged.select(F.col("node").alias("group"), "component"), "group", "left").withColumn("whole", F.coalesce("component", "group")).drop("component"), "groups")
    whole = lead.groupBy("whole").agg(F.min("least").alias("component_id"))
    names = cut(grouped.select("node", *prints, "group").join(lead, "group").join(whole, "whole").select(*[F.col(p).alias(f"n_{p}") for p in prints], "group", "lead", "component_id"), "names")
    by_id = named.select("id", F.col("first").alias("group")).join(lead.select("group", "whole"), "group").join(whole, "whole").select(F.col("id").alias("of_id"), F.col("component_id").alias("by_id"))

    same = (F.col("size") == F.col("n_size")) & (F.col("print1") == F.col("n_print1")) & (F.col("print2") == F.col("n_print2"))
    by_id = cut(by_id, "by_id")
    slim = cut(described.select(*own, "id", "row", *prints), "rows")
    drop(nodes, buckets, described, of, lead)
    out = slim.join(names, same, "left").join(small(by_id), F.col("id") == F.col("of_id"), "left")
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.coalesce("by_id", "id"))
    named_back = [F.col(o).alias(c) for c, o in zip(rest, own, strict=True)]
    out = out.select(*named_back, F.col("size").alias("n_shingles"), component.alias("component_id"), ((F.col("size") == 0) | (F.col("row") == F.col("lead"))).alias("leads_group"))
    out.reads = (slim, names, by_id)  # whoever has written the result may drop them
    return out


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return link_components(docs).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS grams FROM d
), g AS (
  SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 185 * count(*) >= 85 * (x.n + y.n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, min(reach.b) AS component_id FROM s JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id, s.grams
"""
