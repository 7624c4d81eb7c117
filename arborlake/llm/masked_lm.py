"""Masked pseudo-likelihood of documents under a bidirectional window network with a memory.

Each word is predicted from its neighbours on both sides with the word itself
masked; a document's score is the sum of the words' conditional log-probabilities.
The network embeds two words on either side, has one tanh layer, and predicts in
two steps, a class and then a word within the class.  Words beyond the vocabulary
share one id there and are spelled byte by byte after it, so every word has a
probability of its own.  The network starts as the unigram model of the corpus.

Memory.  Which word other documents have in the same window (two words on either
side) is a second prediction, mixed in by a learned gate for each amount of
evidence.  It grows with the corpus: documents are dealt into shards by the
smallest hash of their word sequences, so that texts that share much meet, and a
document's own windows never count for itself.

Counts of words and letters are taken over all rows, and every different text
trains the network: each shard trains a copy with plain numpy, in a fixed order,
and the copies are averaged, weighted by words, in two levels that stream.  Shards
depend on the texts alone, so scores do not depend on how the table is split.
Rows of equal text are one text with a count, and get equal scores.  What reaches
the driver is the vocabulary, the letter table and one network, of fixed size.

Null or wordless text: no words, log-probability 0, mean null.  Very long texts
are cut into slices whose windows reach into their neighbours.  Columns named as
those made here are replaced; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, fresh, read_table, small
from .wordarrays import mix, normalized, window_hashes, word_ends, word_hashes

CHUNK = 1 << 21
SIDE = 2
#: Words of a shard (about), and of a slice of a text.
SHARD_WORDS, SLICE_WORDS = 1 << 20, 1 << 20
#: Words that make up the sequences by which documents are dealt.
ROUTE_WORDS = 5
#: Weights that travel together.
PIECE = 16384
#: Bound of scores, either way, up to which their exponentials and sums of these are floats. Fixed value.
MOST_SCORE = 60
_P = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Shape:
    """``classes`` x ``classes`` word ids, the last of which stands for all rare words; one more id is the edge of a text."""

    classes: int = 64
    width: int = 8
    hidden: int = 16
    gates: int = 8

    @property
    def words(self) -> int:
        return self.classes**2

    @property
    def rare(self) -> int:
        return self.words - 1

    def parts(self) -> list[tuple[int, ...]]:
        c, h = self.classes, self.hidden
        return [(self.words + 1, self.width), (2 * SIDE * self.width, h), (h,), (h, c), (c,), (c, h, c), (c, c), (self.gates,)]

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self.parts():
            n = int(np.prod(shape))
            out.append(flat[at : at + n].reshape(shape))
            at += n
        return out

    def start(self, counts: np.ndarray, seed: int = 7) -> np.ndarray:
        """The unigram model of ``counts`` by id."""
        rng = np.random.default_rng(seed)
        flat = np.zeros(sum(int(np.prod(s)) for s in self.parts()), np.float32)
        emb, w, _, _, bc, _, bi, _ = self.split(flat)
        emb[:], w[:] = rng.normal(0, 0.3, emb.shape), rng.normal(0, 0.2, w.shape)
        table = (counts + 1e-3).reshape(self.classes, self.classes).T  # class, place within it
        bc[:], bi[:] = np.log(table.sum(axis=1) / table.sum()), np.log(table / table.sum(axis=1, keepdims=True))
        return flat


class Vocabulary:
    """Ids of the frequent words, most frequent first, and the spelling of all others."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, total: int, letters: np.ndarray, shape: Shape):
        order = np.argsort(frequent)
        self.hashes, self.ranks, self.shape, self.total = frequent[order], order, shape, total
        self.counts = np.zeros(shape.words)
        self.counts[: len(counts)] = counts
        self.counts[shape.rare] = total - counts.sum()
        follows = letters.reshape(256, 256) + 0.1
        self.spelling = np.log(follows / follows.sum(axis=1, keepdims=True))

    def ids(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), self.shape.rare)
        i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[i] == h, self.ranks[i], self.shape.rare)

    def spelled(self, norm: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-probability of each word's bytes, its end included."""
        before = np.concatenate([np.array([32], np.uint8), norm[:-1]])
        total = np.cumsum(self.spelling[before, norm])[ends]
        return np.diff(total, prepend=0)


@dataclass
class Words:
    """Words of a shard in a row: hashes, ids, spelling, text number and whether they are in the text (not a slice's margin)."""

    h: np.ndarray
    ids: np.ndarray
    spelled: np.ndarray
    text: np.ndarray
    inside: np.ndarray
    piece: np.ndarray


def read_words(texts: list[bytes], vocabulary: Vocabulary) -> Words:
    """Words of all texts; texts beyond a slice are cut into slices with margins."""
    parts: list[tuple[int, bytes, int, int]] = []  # text, bytes, margin before and after
    for i, t in enumerate(texts):
        if len(t) <= 2 * SLICE_WORDS or len(w := t.split()) <= SLICE_WORDS:
            parts.append((i, t, 0, 0))
            continue
        for at in range(0, len(w), SLICE_WORDS):
            a, b = max(0, at - SIDE), min(len(w), at + SLICE_WORDS + SIDE)
            parts.append((i, b" ".join(w[a:b]), at - a, b - min(len(w), at + SLICE_WORDS)))
    out: list[list[np.ndarray]] = [[], [], [], [], [], []]
    first = 0
    while first < len(parts):
        last, size = first, 0
        while last < len(parts) and (size < CHUNK or last == first):
            size += len(parts[last][1])
            last += 1
        own = [normalized(p[1].lower()) for p in parts[first:last]]
        norm = np.concatenate(own)
        ends = word_ends(norm)
        n = np.diff(np.searchsorted(ends, np.cumsum([len(x) for x in own])), prepend=0)
        h = word_hashes(norm, ends)
        ids = vocabulary.ids(h)
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        inside = (place >= np.repeat([p[2] for p in parts[first:last]], n)) & (place < np.repeat(n - [p[3] for p in parts[first:last]], n))
        for o, x in zip(out, (h, ids, np.where(ids == vocabulary.shape.rare, vocabulary.spelled(norm, ends), 0.0), np.repeat([p[0] for p in parts[first:last]], n), inside, np.repeat(np.arange(first, last), n)), strict=True):
            o.append(x)
        first = last
    h, ids, spelled, text, inside, piece = (np.concatenate(o) if o else np.zeros(0, k) for o, k in zip(out, (np.uint64, np.int64, float, np.int64, bool, np.int64), strict=True))
    return Words(h, ids, spelled, text, inside, piece)


def neighbours(values: np.ndarray, piece: np.ndarray, edge) -> np.ndarray:
    """For each word the values of its neighbours within the piece of text, nearest places in order."""
    out = np.full((len(values), 2 * SIDE), edge, values.dtype)
    for col, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        a, b = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
        out[a, col] = np.where(piece[a] == piece[b], values[b], edge)
    return out


def _tally(key: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each row the weight of all rows with its key."""
    order = np.argsort(key)
    head = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]])) if len(key) else np.zeros(0, np.int64)
    out = np.empty(len(key))
    out[order] = np.repeat(np.add.reduceat(weight[order], head), np.diff(np.append(head, len(key)))) if len(key) else 0
    return out


def memory(words: Words, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(evidence, probability) of each word by the windows of other rows: how often they have its window, and its share there."""
    near = neighbours(words.h, words.piece, np.uint64(0))
    window = np.zeros(len(words.h), np.uint64)
    for c in range(2 * SIDE):
        window = mix(window * _P + near[:, c])
    inside = words.inside.astype(np.float64)
    weight = copies[words.text] * inside
    seen, share = _tally(window, weight), np.zeros(len(window))
    # most windows are their word's alone: the rest is counted by document and word
    at = np.flatnonzero(seen > inside)
    window, exact = window[at], mix(window[at] * _P + words.h[at])
    own = mix(words.text[at].astype(np.uint64) + np.uint64(1))
    others = seen[at] - _tally(window * _P + own, inside[at])
    hit = _tally(exact, weight[at]) - _tally(exact * _P + own, inside[at])
    seen[:] = 0
    seen[at], share[at] = others, np.where(others > 0, hit / np.maximum(others, 1), 0.0)
    return seen, share


def _with_bias(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights with their bias as a last row, for inputs with a last column of ones."""
    return np.concatenate([w, b[..., None, :]], axis=-2)


def _lift(x: np.ndarray, weights: np.ndarray) -> None:
    """Rows less their maximum, in place, where ``weights`` with their bias could give values within -1 and 1 scores whose
    exponentials a float would not bear."""
    if not np.abs(weights).sum(axis=-2).max() <= MOST_SCORE:
        x -= x.max(axis=1, keepdims=True)


def _softmax(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """In place."""
    _lift(x, weights)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    return x


def _log_of(x: np.ndarray, pick: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log-probability of one column of each row of scores."""
    _lift(x, weights)
    own = x[np.arange(len(x)), pick].astype(np.float64)
    np.exp(x, out=x)
    return own - np.log(x @ np.ones(x.shape[1], x.dtype))


def _hidden(emb: np.ndarray, w: np.ndarray, b: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedded neighbours, and the hidden layer with a last column of ones."""
    x = emb[near].reshape(len(near), -1)
    hid = np.ones((len(near), len(b) + 1), emb.dtype)
    np.tanh(x @ w + b, out=hid[:, :-1])
    return x, hid


def network_log_probabilities(shape: Shape, flat: np.ndarray, ids: np.ndarray, near: np.ndarray, rows: int = 2048) -> np.ndarray:
    """Of each id given its neighbours, by the network alone."""
    emb, w, b, wc, bc, wi, bi, _ = shape.split(flat)
    out = np.empty(len(ids), np.float64)
    cls, inner = ids % shape.classes, ids // shape.classes
    order = np.argsort(cls, kind="stable")  # words of a class lie together
    edges = np.searchsorted(cls[order], np.arange(shape.classes + 1))
    outer = _with_bias(wc, bc)
    for c in np.flatnonzero(np.diff(edges)):
        within = _with_bias(wi[c], bi[c])
        for lo in range(edges[c], edges[c + 1], rows):
            part = order[lo : min(lo + rows, edges[c + 1])]
            _, hid = _hidden(emb, w, b, near[part])
            out[part] = _log_of(hid @ outer, cls[part], outer) + _log_of(hid @ within, inner[part], within)
    return out


def gate_of(seen: np.ndarray, gates: int) -> np.ndarray:
    """The gate for each amount of evidence: by powers of two, -1 for none."""
    return np.where(seen > 0, np.minimum(np.log2(np.maximum(seen, 1)).astype(np.int64), gates - 1), -1)


def mixed(net: np.ndarray, seen: np.ndarray, share: np.ndarray, gates: np.ndarray) -> np.ndarray:
    """Log-probabilities of the network and the memory together."""
    g = 1 / (1 + np.exp(-gates.astype(np.float64)))
    k = gate_of(seen, len(gates))
    return np.where(k < 0, net, np.log((1 - g[k]) * np.exp(net) + g[k] * share + 1e-300))


def train(shape: Shape, flat: np.ndarray, words: Words, seen: np.ndarray, share: np.ndarray, rate: float = 0.15, batch: int = 8192) -> np.ndarray:
    """Adagrad over the words once, in order."""
    flat = flat.copy()
    emb, w, b, wc, bc, wi, bi, gates = shape.split(flat)
    square = np.full_like(flat, 1e-4)
    s_emb, s_w, s_b, s_wc, s_bc, s_wi, s_bi, s_gates = shape.split(square)

    def move(p: np.ndarray, s: np.ndarray, g: np.ndarray) -> None:
        s += g * g
        p -= rate * g / np.sqrt(s)

    at = np.flatnonzero(words.inside)
    near = neighbours(words.ids, words.piece, shape.words)
    kind = gate_of(seen, shape.gates)
    for lo in range(0, len(at), batch):
        rows = at[lo : lo + batch]
        y, n = words.ids[rows], near[rows]
        m = len(y)
        cls = y % shape.classes
        order = np.argsort(cls, kind="stable")  # words of a class lie together
        y, n, cls, rows = y[order], n[order], cls[order], rows[order]
        x, hid = _hidden(emb, w, b, n)
        inner, each = y // shape.classes, np.arange(m)
        outer, within = _with_bias(wc, bc), _with_bias(wi, bi)
        g = _softmax(hid @ outer, outer)
        net = np.log(g[each, cls].astype(np.float64) + 1e-30)
        g[each, cls] -= 1
        g /= m
        back = g @ wc.T
        change = hid.T @ g
        move(wc, s_wc, change[:-1])
        move(bc, s_bc, change[-1])
        edges = np.searchsorted(cls, np.arange(shape.classes + 1))
        parts = [(c, slice(edges[c], edges[c + 1])) for c in np.flatnonzero(np.diff(edges))]
        for c, part in parts:
            np.matmul(hid[part], within[c], out=g[part])
        g = _softmax(g, within)
        net += np.log(g[each, inner].astype(np.float64) + 1e-30)
        g[each, inner] -= 1
        g /= m
        change = np.zeros_like(within)  # of classes without words here nothing moves
        for c, part in parts:
            back[part] += g[part] @ wi[c].T
            np.matmul(hid[part].T, g[part], out=change[c])
        move(wi, s_wi, change[:, :-1])
        move(bi, s_bi, change[:, -1])
        hid = hid[:, :-1]
        back *= 1 - hid * hid
        gx = (back @ w.T).reshape(-1, shape.width)
        move(w, s_w, x.T @ back)
        move(b, s_b, back.sum(axis=0))
        flat_n = n.ravel()
        ge = np.stack([np.bincount(flat_n, gx[:, j], shape.words + 1) for j in range(shape.width)], axis=1).astype(np.float32)
        move(emb, s_emb, ge)
        # gates: each word says whether the memory or the network gives it more
        p, q = np.exp(net + words.spelled[rows]), share[rows]
        known = kind[rows] >= 0
        open_ = 1 / (1 + np.exp(-gates[kind[rows][known]].astype(np.float64)))
        p, q = p[known], q[known]
        pull = open_ * (1 - open_) * (p - q) / ((1 - open_) * p + open_ * q + 1e-300) / m
        move(gates, s_gates, np.bincount(kind[rows][known], pull, shape.gates).astype(np.float32))
    return flat


# over the corpus


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with their texts."""
    for batch in batches:
        start = size = 0
        col, texts = batch.column(column), []
        for i in range(len(batch)):
            texts.append((col[i].as_py() or "").encode())
            size += len(texts[-1])
            if size >= CHUNK or i == len(batch) - 1:
                yield batch.slice(start, i + 1 - start), texts
                start, size, texts = i + 1, 0, []


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalized bytes, word hashes, and the number of words of each text."""
    parts = [normalized(t.lower()) if t else np.zeros(0, np.uint8) for t in texts]
    norm = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    ends = word_ends(norm)
    counts = np.diff(np.searchsorted(ends, np.cumsum([len(p) for p in parts])), prepend=0)
    return norm, word_hashes(norm, ends), counts


def learn_vocabulary(texts: DataFrame, shape: Shape) -> Vocabulary:
    """Frequent words (ties to the smaller hash) and letter pairs over all rows of a one-column table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        pairs = np.zeros(1 << 16, np.int64)

        def together() -> pa.RecordBatch:
            h, n = (np.concatenate(x) for x in zip(*held, strict=True))
            u, at = np.unique(h, return_inverse=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([False] * len(u)), pa.array(u.view(np.int64)), pa.array(np.bincount(at, n).astype(np.int64))], names=["pair", "h", "n"])

        for _, part in _texts(batches, 0):
            norm, h, _ = _hashes(part)
            if len(norm):
                pairs += np.bincount((np.concatenate([np.array([32]), norm[:-1].astype(np.int64)]) << 8) | norm, minlength=1 << 16)
            held.append(np.unique(h, return_counts=True))
            if sum(len(x[0]) for x in held) > 3_000_000:
                yield together()
        if held:
            yield together()
        used = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([True] * len(used), pa.bool_()), pa.array(used), pa.array(pairs[used])], names=["pair", "h", "n"])

    counts = cut(texts.mapInArrow(count, "pair boolean, h bigint, n bigint").groupBy("pair", "h").agg(F.sum("n").alias("n")), "lm_counts")
    words, most = counts.where("NOT pair"), shape.words - 1
    # words below the step that completes the vocabulary can't be in it, so tasks need not send theirs
    step = F.floor(F.log2("n") * 8)
    enough = found = total = 0
    for r in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("n")).orderBy(F.desc("step")).collect():  # at most 8 x 63 rows
        if found < most:
            enough, found = r["step"], found + r["count"]
        total += r["n"]
    top = words.where(step >= enough).orderBy(F.desc("n"), "h").limit(most).collect()  # at most the vocabulary
    letters = np.zeros(1 << 16)
    for r in counts.where("pair").collect():  # at most 65,536 rows
        letters[r["h"]] = r["n"]
    drop(counts)
    return Vocabulary(np.array([r["h"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], np.float64), total, letters, shape)


@dataclass
class Dealt:
    """Different texts by shard: ``shard, route, k1, k2, copies, text`` (a text's further copies may be rows without it)."""

    table: DataFrame
    shards: int
    vocabulary: Vocabulary


def deal(docs: DataFrame, vocabulary: Vocabulary, shard_words: int = SHARD_WORDS) -> Dealt:
    """``docs`` has the columns k1, k2 (hashes of the text) and t."""
    shards = max(1, -(-vocabulary.total // shard_words))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list[int]] = {}  # texts of this task: route, words, further copies
        names = ["route", "k1", "k2", "words", "copies", "t"]
        for batch, texts in _texts(batches, 2):
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            new = []
            for i, k in enumerate(keys):
                if k in seen:
                    seen[k][2] += 1
                else:
                    seen[k] = [0, 0, 0]
                    new.append(i)
            _, h, counts = _hashes([texts[i] for i in new])
            first = 0
            for i, n in zip(new, counts.tolist(), strict=True):
                own = h[first : first + n]
                first += n
                low = window_hashes(own, min(n, ROUTE_WORDS)).min() if n else np.uint64(0)
                seen[keys[i]][:2] = [int(low.view(np.int64)), n]
            yield pa.RecordBatch.from_arrays([pa.array([seen[keys[i]][0] for i in new], pa.int64()), pa.array([keys[i][0] for i in new], pa.int64()), pa.array([keys[i][1] for i in new], pa.int64()), pa.array([seen[keys[i]][1] for i in new], pa.int64()), pa.array([1] * len(new), pa.int64()), pa.array([texts[i].decode() for i in new], pa.string())], names=names)
        more = [(v[0], *k, 0, v[2], None) for k, v in seen.items() if v[2]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in more], k) for i, k in enumerate([pa.int64()] * 5 + [pa.string()])], names=names)

    rows = cut(docs.select("k1", "k2", "t").mapInArrow(route, "route bigint, k1 bigint, k2 bigint, words bigint, copies bigint, t string"), "lm_routes")
    # routes of more words than a shard are spread by text
    hot = cut(rows.groupBy("route").agg(F.sum("words").alias("words")).where(F.col("words") > shard_words // 2).select("route", F.ceil(F.col("words") / (shard_words // 2)).alias("spread")), "lm_hot")
    spread = F.when(F.col("spread").isNull(), F.lit(0)).otherwise(F.pmod(F.col("k1"), F.col("spread")))
    shard = F.pmod(F.xxhash64("route", spread), F.lit(shards)).cast("int")
    return Dealt(rows.join(small(hot), "route", "left").select(shard.alias("shard"), "route", "k1", "k2", "copies", "t"), shards, vocabulary)


def _by_shard(dealt: Dealt, work, schema: str) -> DataFrame:
    """Apply ``work(shard, keys, texts, copies)`` to each shard, texts in the order of their route and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, texts, copies = None, [], [], []
        for b in batches:
            for s, k1, k2, n, t in zip(*(b.column(c).to_pylist() for c in ("shard", "k1", "k2", "copies")), b.column("t"), strict=True):
                if s != now:
                    if keys:
                        yield from work(now, keys, texts, np.array(copies, np.float64))
                    now, keys, texts, copies = s, [], [], []
                if keys and keys[-1] == (k1, k2):
                    copies[-1] += n
                else:
                    keys.append((k1, k2))
                    texts.append(b"")
                    copies.append(n)
                if t.is_valid:
                    texts[-1] = t.as_py().encode()
        if keys:
            yield from work(now, keys, texts, np.array(copies, np.float64))

    tasks = max(int(dealt.table.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(dealt.shards, 1 << 16))
    return dealt.table.repartition(tasks, "shard").sortWithinPartitions("shard", "route", "k1", "k2").mapInArrow(run, schema)


def fit(dealt: Dealt, rate: float = 0.15) -> np.ndarray:
    """The weights: every shard trains a copy of the unigram start, and the copies are averaged."""
    spark = dealt.table.sparkSession
    shape = dealt.vocabulary.shape
    flat = shape.start(dealt.vocabulary.counts)
    shared = spark.sparkContext.broadcast((dealt.vocabulary, flat))
    kind = "piece int, fan int, shard int, n bigint, w binary"
    fan = max(1, int(dealt.shards**0.5))

    def row(piece: int, f: int, shard: int, n: int, w: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([f], pa.int32()), pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["piece", "fan", "shard", "n", "w"])

    def work(shard: int, keys, texts: list[bytes], copies: np.ndarray) -> Iterator[pa.RecordBatch]:
        vocabulary, start = shared.value
        words = read_words(texts, vocabulary)
        n = int(words.inside.sum())
        if n:
            own = train(shape, start, words, *memory(words, copies), rate=rate).astype(np.float64) * n
            for i in range(0, len(own), PIECE):
                yield row(i // PIECE, shard % fan, shard, n, own[i : i + PIECE])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, total = None, 0, None
        for b in batches:
            for piece, f, _, m, w in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
                if (piece, f) != now:
                    if now is not None:
                        yield row(*now, 0, n, total)
                    now, n, total = (piece, f), 0, 0.0
                n, total = n + m, total + np.frombuffer(w.as_py(), np.float64)
        if now is not None:
            yield row(*now, 0, n, total)

    # sums in a fixed order, so that they are the same whatever task does them
    level = _by_shard(dealt, work, kind)
    for keys, order in ((["piece", "fan"], ["piece", "fan", "shard"]), (["piece"], ["piece", "fan"])):
        level = level.repartition(*keys).sortWithinPartitions(*order).mapInArrow(add, kind)
        level = cut(level, "lm_sums") if keys == ["piece", "fan"] else level.withColumn("fan", F.lit(0))
        level = level if keys == ["piece"] else level.withColumn("shard", F.col("fan"))
    pieces: dict[int, list] = {}
    for r in level.collect():  # one network
        pieces.setdefault(r["piece"], []).append(r)
    for p, rows in pieces.items():
        part = sum(np.frombuffer(r["w"], np.float64) for r in rows) / sum(r["n"] for r in rows)
        flat[p * PIECE : p * PIECE + len(part)] = part
    return flat


def evaluate(dealt: Dealt, flat: np.ndarray) -> DataFrame:
    """Rows ``k1, k2, n_words, log_prob`` of all texts."""
    shape = dealt.vocabulary.shape
    shared = dealt.table.sparkSession.sparkContext.broadcast((dealt.vocabulary, flat))

    def work(shard: int, keys, texts: list[bytes], copies: np.ndarray) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = shared.value
        words = read_words(texts, vocabulary)
        net = network_log_probabilities(shape, weights, words.ids, neighbours(words.ids, words.piece, shape.words)) + words.spelled
        p = mixed(net, *memory(words, copies), shape.split(weights)[-1]) * words.inside
        n, total = np.bincount(words.text, words.inside, len(keys)), np.bincount(words.text, p, len(keys))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(n.astype(np.int64)), pa.array(total)], names=["k1", "k2", "n_words", "log_prob"])

    return _by_shard(dealt, work, "k1 bigint, k2 bigint, n_words bigint, log_prob double")


def score_corpus(docs: DataFrame, text: str = "text", shape: Shape = Shape(), rate: float = 0.15, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without its text, plus ``n_words, log_prob, mean_log_prob``."""
    made = ["n_words", "log_prob", "mean_log_prob"]
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), *made)]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    k1, k2 = fresh(docs.columns + made, "lm_key1", "lm_key2")
    texts = docs.select(F.xxhash64(body).alias("k1"), F.xxhash64(body, F.lit(41)).alias("k2"), body.alias("t"))
    dealt = deal(texts, learn_vocabulary(texts.select("t"), shape), shard_words)
    scores = cut(evaluate(dealt, fit(dealt, rate)).select(F.col("k1").alias(k1), F.col("k2").alias(k2), *[F.col(c) for c in made[:2]]), "lm_scores")
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.xxhash64(body).alias(k1), F.xxhash64(body, F.lit(41)).alias(k2))
    out = rows.join(small(scores), [k1, k2], "left").drop(k1, k2)
    return out.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))


def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_corpus(docs).select("doc_id", "n_words", "log_prob", "mean_log_prob")
