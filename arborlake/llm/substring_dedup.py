"""Substring dedup: words that lie in a window which also starts elsewhere are removed.

Super-k-mer partitioning.  A window is ``window`` consecutive words; its
minimiser is the smallest hash among its ``minimiser``-word sequences, so equal
windows have equal minimisers.  Consecutive windows with the same minimiser
travel as one packed string of words to the minimiser's bucket, where windows
are sorted by fingerprint, equal fingerprints are compared word for word, and
those that occur twice are flagged.  Flagged spans return to their row by its
key, its id and 32 bits of its text's hash (for a null id 96 bits of the hash).

A string that one task meets more than once settles there: all its windows are
repeats, so their spans are known, and the bucket gets the string a single time
without its places.  A passage that fills a third of the corpus costs a bucket
one string for each task that read it, not one for each document.

Windows are judged on the input.  Null text has no words; texts under one window
lose nothing.  Repeated rows are copies of each other.  Very long texts travel in
parts that overlap by a window less a word.  Columns named as those made here are
replaced, others keep their names; an empty table gives none.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, frugal, read_table, widened
from .wordarrays import inverse, mix, normalized, powers, sliding_min, window_hashes, word_ends, word_hashes

#: Bytes of text that are tokenized at once, and bytes of packed strings that are sent at once.
CHUNK, FLUSH = 1 << 21, 40 << 20
_P = 0xC2B2AE3D27D4EB4F


def split_long(text: bytes, window: int) -> Iterator[tuple[int, bytes]]:
    """(words before, bytes): parts of a text that overlap by ``window`` - 1 words, so that each window lies in one."""
    if len(text) <= CHUNK:
        yield 0, text
        return
    words = text.split()
    step = max(window, len(words) * CHUNK // len(text))
    for i in range(0, max(1, len(words) - window + 1), step):
        yield i, b" ".join(words[i : i + step + window - 1])


class Sender:
    """Collects super-k-mers of a task's rows and gives blobs by bucket."""

    def __init__(self, window: int, minimiser: int, bucket_bits: int):
        self.k, self.m, self.bits = window, minimiser, bucket_bits
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self.places: dict[bytes, list[tuple[int, int, int]]] = {}
        self.bucket_of: dict[bytes, int] = {}

    def add(self, texts: list[tuple[int, int, int, bytes]]) -> None:
        """texts: (key, key, words before, bytes)."""
        k, m = self.k, self.m
        parts = [normalized(t[3]) if t[3] else np.zeros(0, np.uint8) for t in texts]
        norm = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        ends = word_ends(norm)
        if len(ends) < k:
            return
        doc = np.searchsorted(np.cumsum([len(p) for p in parts]), ends, side="right")
        first = np.searchsorted(doc, np.arange(len(parts)))
        low = sliding_min(window_hashes(word_hashes(norm, ends), m), k - m + 1)
        valid = doc[: len(low)] == doc[k - 1 :]
        change = np.ones(len(low), bool)
        change[1:] = (low[1:] != low[:-1]) | (doc[1 : len(low)] != doc[: len(low) - 1]) | (valid[1:] != valid[:-1])
        run = np.flatnonzero(change)
        length = np.diff(np.append(run, len(low)))
        good = valid[run]
        run, length = run[good], length[good]
        starts = np.concatenate([[0], ends[:-1] + 1])
        data = norm.tobytes()
        bucket = (low[run] * np.uint64(_P)) >> np.uint64(64 - self.bits)
        places, bucket_of = self.places, self.bucket_of
        for d, w, n, a, b, to in zip(doc[run].tolist(), (run - first[doc[run]]).tolist(), length.tolist(), starts[run].tolist(), ends[run + length - 1 + k - 1].tolist(), bucket.tolist(), strict=True):
            s = data[a:b]
            x = texts[d]
            at = (x[0], x[1], x[2] + w, n)
            if (seen := places.get(s)) is None:
                places[s], bucket_of[s] = [at], to
                self.size += b - a
            else:
                seen.append(at)

    def flush(self) -> Iterator[tuple[int, bytes]]:
        strings: dict[int, list[bytes]] = {}
        known: list[tuple[int, int, int, int]] = []
        for s, at in self.places.items():
            strings.setdefault(self.bucket_of[s], []).append(s)
            if len(at) > 1:
                known += [(a, b, w, w + n + self.k - 1) for a, b, w, n in at]
        spans = merged(np.array(known, np.int64).reshape(-1, 4))
        to = mix(np.ascontiguousarray(spans[:, 0]).view(np.uint64)) >> np.uint64(64 - self.bits)
        order = np.argsort(to, kind="stable")
        cut_at = np.flatnonzero(np.diff(to[order])) + 1
        direct = {int(to[i[0]]): spans[i] for i in np.split(order, cut_at) if len(i)}
        pack = zstandard.ZstdCompressor(level=6).compress
        for b in strings.keys() | direct.keys():
            own = strings.get(b, [])
            at = np.array([(p[0][:3] if len(p := self.places[s]) == 1 else (0, 0, -1)) for s in own], np.int64).reshape(-1, 3)
            # ids of neighbours lie close together: differences compress
            places = (np.diff(at[:, 0], prepend=0), at[:, 1].astype(np.uint32), at[:, 2].astype(np.int32) if at[:, 2].max(initial=0) < 1 << 31 else at[:, 2])
            yield b, pack(pickle.dumps((b"\n".join([*own, b""]), places, direct.get(b))))
        self.clear()


def merged(spans: np.ndarray) -> np.ndarray:
    """Rows (key, key, from, to), sorted, overlapping or touching ones of a key as one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    new_key = np.ones(len(spans), bool)
    new_key[1:] = (spans[1:, :2] != spans[:-1, :2]).any(axis=1)
    # the furthest end so far within a key: ends are lifted by key number, so one running maximum does
    lift = np.cumsum(new_key) * np.int64(1 << 40)
    far = np.maximum.accumulate(spans[:, 3] + lift)
    new = new_key.copy()
    new[1:] |= spans[1:, 2] + lift[1:] > far[:-1]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(spans)) - 1
    return np.column_stack([spans[head, :3], (far - lift)[last]])


def repeats(blobs: list[bytes], k: int) -> np.ndarray:
    """Spans (key, key, from, to) of one bucket: of windows that occur at least twice."""
    texts, ats, spans = [], [], []
    unpack = zstandard.ZstdDecompressor().decompress
    for x in blobs:
        text, at, direct = pickle.loads(unpack(x))
        texts.append(text)
        ats.append(np.column_stack([np.cumsum(at[0]), at[1].astype(np.int64), at[2].astype(np.int64)]))
        if direct is not None:
            spans.append(direct)
    data, at = b"".join(texts), np.concatenate(ats)
    del texts
    if data:
        norm = np.frombuffer(data, np.uint8)
        ends = word_ends(norm)
        starts = np.concatenate([[0], ends[:-1] + 1])
        own = np.cumsum(np.concatenate([[0], norm[ends[:-1]] == 10]))  # the string of each word
        h = word_hashes(norm, ends)
        n = len(ends)
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(h * powers(_P, n), out=s[1:])
        window = np.flatnonzero(own[: n - k + 1] == own[k - 1 :])
        print_of = (s[window + k] - s[window]) * powers(inverse(_P), n)[window]
        order = np.argsort(print_of)
        same = print_of[order[1:]] == print_of[order[:-1]]
        hit = (at[own[window], 2] < 0)
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        sizes = np.diff(np.append(head, len(order)))
        a, b = starts[window], ends[window + k - 1]
        for i, size in zip(head[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            group = order[i : i + size]
            words = [data[x:y] for x, y in zip(a[group].tolist(), b[group].tolist(), strict=True)]
            if words.count(words[0]) == size:
                hit[group] = True
            else:  # fingerprints that collide: count the words themselves
                hit[group] |= np.array([words.count(x) > 1 for x in words])
        mine = hit & (at[own[window], 2] >= 0)
        w = window[mine]
        if len(w):
            o = own[w]
            place = at[o, 2] + (w - np.searchsorted(own, o))
            spans.append(merged(np.column_stack([at[o, 0], at[o, 1], place, place + k])))
    return np.concatenate(spans) if spans else np.zeros((0, 4), np.int64)


def repeated_spans(docs: DataFrame, text: str, key1: str, key2: str, window: int, minimiser: int) -> DataFrame:
    """Rows ``key1, key2, start, stop``: words of repeated windows."""
    spark = docs.sparkSession
    part = spark.conf.get("spark.sql.files.maxPartitionBytes").lower().rstrip("b")
    mega = int(part[:-1]) * {"k": 1 / 1024, "m": 1, "g": 1024}[part[-1]] if part[-1].isalpha() else int(part) / 2**20
    # about 6 times the input is sent; a bucket holds some megabytes at any scale, and a task has one bucket at a time in memory
    guess = 6 * docs.rdd.getNumPartitions() * max(mega, 1)
    bits = min(48, max(9, (int(guess / 6) - 1).bit_length()))
    tasks = min(1 << 16, max(24, int(guess / 48)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, waiting, size = Sender(window, minimiser, bits), [], 0

        def blobs() -> Iterator[pa.RecordBatch]:
            rows: list[tuple[int, bytes]] = []
            for row in sender.flush():
                rows.append(row)
                if len(rows) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for a, b, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for base, x in split_long((t.as_py() or "").encode(), window):
                    waiting.append((a, b, base, x))
                    size += len(x)
                    if size >= CHUNK:
                        sender.add(waiting)
                        waiting, size = [], 0
                        if sender.size >= FLUSH:
                            yield from blobs()
        sender.add(waiting)
        yield from blobs()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(blobs: list[bytes]) -> pa.RecordBatch:
            x = repeats(blobs, window)
            return pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(4)], names=["key1", "key2", "start", "stop"])

        now, own = None, []
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != now and own:
                    yield done(own)
                    own = []
                now = b
                own.append(x.as_py())
        if own:
            yield done(own)

    sent = docs.select(key1, key2, text).mapInArrow(frugal(send), "bucket long, blob binary")
    return sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(frugal(count), "key1 long, key2 long, start long, stop long")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = 35, minimiser: int = 10, keep_text: bool = True) -> DataFrame:
    """``docs`` plus ``kept_text`` (kept words joined by one space), ``n_words, n_removed`` and ``removed`` (word spans,
    end exclusive); columns of these names are replaced, and without ``keep_text`` the text itself is left out."""
    made = ["kept_text", "n_words", "n_removed", "removed"]
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), *made)]
    t, k1, k2, sp = fresh(docs.columns + made, "dedup_text", "dedup_key1", "dedup_key2", "dedup_spans")
    name = F.col(f"`{id_column}`")
    key = F.coalesce(name.cast("long") if docs.schema[id_column].dataType.typeName() in ("long", "integer", "short", "byte") else F.xxhash64(name), F.xxhash64(F.col(f"`{text}`")))
    src = docs.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(t), key.alias(k1), F.shiftrightunsigned(F.xxhash64(F.col(f"`{text}`"), F.lit(35)), 32).alias(k2))
    spans = repeated_spans(src, t, k1, k2, window, minimiser)
    spans = spans.groupBy(F.col("key1").alias(k1), F.col("key2").alias(k2)).agg(F.collect_set(F.struct("start", "stop")).alias(sp))
    df = src.join(spans, [k1, k2], "left").select(*[F.col(f"`{c}`") for c in rest], t, sp)
    schema = widened(df.drop(t, sp).schema, f"`{text}` string, " * keep_text + "kept_text string, n_words bigint, n_removed bigint, removed array<struct<start: bigint, stop: bigint>>")
    pair = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, total, gone, out = [], [], [], []
            for v, found in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True):
                words, ranges = v.as_py().encode().split(), []
                for x in sorted((x["start"], x["stop"]) for x in found.as_py() or []):
                    if ranges and x[0] <= ranges[-1][1]:
                        ranges[-1] = (ranges[-1][0], max(x[1], ranges[-1][1]))
                    else:
                        ranges.append(x)
                total.append(len(words))
                gone.append(sum(y - x for x, y in ranges))
                for x, y in reversed(ranges):
                    del words[x:y]
                kept.append(b" ".join(words).decode())
                out.append([{"start": x, "stop": y} for x, y in ranges])
            yield pa.RecordBatch.from_arrays([*b.columns[: -1 if keep_text else -2], pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pair)], names=schema.names)

    return df.mapInArrow(frugal(keep), schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT rn, i, array_to_string(words[i + 1:i + 35], ' ') AS win FROM (SELECT rn, words, unnest(range(0, len(words) - 34)) AS i FROM d)
), gone AS (
  SELECT DISTINCT rn, unnest(range(i, i + 35)) AS j FROM p WHERE win IN (SELECT win FROM p GROUP BY win HAVING count(*) > 1)
), w AS (
  SELECT rn, unnest(range(0, len(words))) AS j, unnest(words) AS word FROM d
), kept AS (
  SELECT w.rn, count(gone.j) AS n_removed, string_agg(w.word, ' ' ORDER BY w.j) FILTER (gone.j IS NULL) AS text
  FROM w LEFT JOIN gone USING (rn, j) GROUP BY w.rn
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(kept.n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rn)
"""
