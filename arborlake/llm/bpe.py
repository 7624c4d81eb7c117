"""Byte-level BPE encoding and decoding, exact to a tokenizer file.

Ordinary text is split by the file's pattern and merged by rank.  Long text is
encoded by tree concatenation: it is cut into leaves wherever they end, each leaf
is a row that any task may encode, and neighbouring halves are joined level by
level, each join a row too.  At a join a growing window of pre-tokens of both
sides is split again until its first and last one agree with those that the two
sides have there.  The scan that splits goes forward from a boundary and looks
one character ahead, so agreement makes the joined sequence exact; what lies
outside the window is never touched again.

A stretch that the pattern leaves whole (a pre-token of more than ``LONG`` bytes)
is encoded the same way below the level of pre-tokens: its halves on their own,
then a growing window of tokens around each join is encoded again until its ends
agree.  A sequence of BPE tokens is the encoding of its text exactly when every
adjacent pair is, so agreement at both ends makes that join exact as well.

Merging by rank equals merging by the file's list if ranks follow the list and
every token alone encodes to itself; ``Bpe`` checks both when it loads, and
otherwise leaves the whole work to the tokenizers library, as it does for long
texts that hold a special token.

Null text counts as empty: no ids.  Repeated rows are encoded each on its own.
Columns named as those made here are replaced, others keep their names; an empty
table gives none.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, drop, fresh, read_table, widened

#: Bytes above which a pre-token is encoded by halves, and of its leaves.
LONG, LEAF = 2048, 512
#: Characters above which a text is encoded by halves in rows of their own, and of its leaves.
LONG_TEXT, TEXT_LEAF = 49152, 16384
#: How byte-level vocabularies split text. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: visible Latin-1 stands for itself, the rest follows from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Part:
    """A stretch of text with its pre-tokens: characters and ids of each."""

    text: str
    chars: list[int]
    ids: list[list[int]]


class Bpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain = Tokenizer.from_file(path)
        self.plain.no_truncation()
        self.plain.no_padding()
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: t.encode() for t, i in self.special.items()}
        self.fast = None
        added = any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        pre = spec["pre_tokenizer"] or {}
        if not added and len(self.special) <= 1 and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self._load_ranks(spec["model"]["merges"], vocab, letters)
        for t, i in vocab.items():
            if i not in self.bytes_of:
                self.bytes_of[i] = bytes(letters[c] for c in t) if set(t) <= letters.keys() else t.encode()

    def _load_ranks(self, merges: list, vocab: dict[str, int], letters: dict[str, int]) -> None:
        import tiktoken

        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if made != sorted(set(made)) or len(made) + 256 != len(ranks) or min(made, default=256) < 256:
            return
        fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        if all(fast._encode_single_piece(b) == [i] for b, i in ranks.items()):
            self.fast = fast
            self.split = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    # encoding

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit integers."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is None:
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)
        if self.split is None or not self.split.search(text):
            return self._ordinary(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [self._ordinary(text[at : m.start()]), np.array([self.special[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*out, self._ordinary(text[at:])])

    def _ordinary(self, text: str) -> np.ndarray:
        if len(text) * 4 > LONG and (max(map(len, text.split()), default=0) * 4 > LONG or re.search(rf"\s{{{LONG // 4}}}", text)):
            return np.array(self._by_pieces(text), np.uint32)
        return np.frombuffer(self.fast._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32)

    def _by_pieces(self, text: str) -> list[int]:
        out: list[int] = []
        for _, (start, end) in self.plain.pre_tokenizer.pre_tokenize_str(text):
            piece = text[start:end].encode()
            out += self.fast._encode_single_piece(piece) if len(piece) <= LONG else self.tree(piece)
        return out

    def tree(self, piece: bytes) -> list[int]:
        """Encode one pre-token by halves."""
        leaves = [piece[i : i + LEAF] for i in range(0, len(piece), LEAF)]
        with ThreadPoolExecutor(2) as pool:
            parts = list(pool.map(self.fast._encode_single_piece, leaves))
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        w = 4
        while True:
            a, b = left[-w:], right[:w]
            mid = self.fast._encode_single_piece(b"".join(map(self.bytes_of.__getitem__, a + b)))
            if (len(a) == len(left) or mid[0] == a[0]) and (len(b) == len(right) or mid[-1] == b[-1]):
                return left[: len(left) - len(a)] + mid + right[len(b) :]
            w *= 2

    # long text by halves

    def leaf(self, text: str) -> Part:
        chars, ids, known = [], [], {}
        for _, (start, end) in self.plain.pre_tokenizer.pre_tokenize_str(text):
            piece = text[start:end]
            if (found := known.get(piece)) is None:
                found = known[piece] = self.piece(piece)
            chars.append(end - start)
            ids.append(found)
        return Part(text, chars, ids)

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        return self.fast._encode_single_piece(raw) if len(raw) <= LONG else self.tree(raw)

    def join_parts(self, left: Part, right: Part) -> Part:
        """The part that ``left.text + right.text`` alone would give."""
        if not left.chars or not right.chars:
            return right if not left.chars else left
        w = 1
        while True:
            a, b = min(w, len(left.chars)), min(w, len(right.chars))
            window = left.text[len(left.text) - sum(left.chars[-a:]) :] + right.text[: sum(right.chars[:b])]
            spans = [x for _, x in self.plain.pre_tokenizer.pre_tokenize_str(window)]
            agrees = spans[-1][0] == len(window) - right.chars[b - 1]
            if agrees or b == len(right.chars):
                break
            w *= 2
        chars, ids = left.chars[:-a], left.ids[:-a]
        for start, end in spans[:-1] if agrees else spans:
            piece = window[start:end]
            whole = end - start == left.chars[-1] + right.chars[0] and start == sum(left.chars[-a:-1])
            chars.append(end - start)
            # two halves of one pre-token: their tokens are joined
            ids.append(self.join(left.ids[-1], right.ids[0]) if whole and len(piece) > LONG else self.piece(piece))
        keep = b - 1 if agrees else b
        return Part(left.text + right.text, chars + right.chars[keep:], ids + right.ids[keep:])

    # decoding

    def decode(self, ids) -> str:
        """Text of ids, special tokens included; unknown ids stand for nothing."""
        return b"".join([self.bytes_of.get(i, b"") for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace")


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_long(texts: DataFrame, path: str) -> DataFrame:
    """Rows ``row, ids`` (array) of ``row, text``: leaves as rows, then halves joined level by level."""
    most = texts.agg(F.max(F.length("text"))).first()[0] or 0
    names, kind = ["row", "pos", "part"], "row bigint, pos bigint, part binary"
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())

    def batch(row: int, pos: int, part: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([pos], pa.int64()), pa.array([pickle.dumps(part)], pa.binary())], names=names)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py()
                for k, at in enumerate(range(0, len(text), TEXT_LEAF)):
                    yield batch(row, k, text[at : at + TEXT_LEAF])

    def encode_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for row, pos, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                yield batch(row, pos, bpe.leaf(pickle.loads(x.as_py())))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, held = load(path), None
        for b in batches:
            for row, pos, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                part = pickle.loads(x.as_py())
                if held is not None and held[:2] == (row, pos - 1) and pos % 2:
                    yield batch(row, pos // 2, bpe.join_parts(held[2], part))
                    held = None
                    continue
                if held is not None:
                    yield batch(held[0], held[1] // 2, held[2])
                held = (row, pos, part)
        if held is not None:
            yield batch(held[0], held[1] // 2, held[2])

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, x in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                ids = np.array([i for p in pickle.loads(x.as_py()).ids for i in p], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names=["row", "ids"])

    level = cut(texts.select("row", "text").mapInArrow(leaves, kind).repartition(tasks, "row", "pos").mapInArrow(encode_leaf, kind), "bpe_leaves")
    n = -(-most // TEXT_LEAF)
    while n > 1:
        pairs = level.repartition(tasks, "row", F.floor(F.col("pos") / 2)).sortWithinPartitions("row", "pos")
        above = cut(pairs.mapInArrow(join, kind), "bpe_level")
        drop(level)
        level, n = above, -(-n // 2)
    return level.mapInArrow(flat, "row bigint, ids array<int>")


def _with_ids(docs: DataFrame, text: str, path: str | None, made: str, f, arrow: list) -> DataFrame:
    """The other columns plus those of the schema ``made``, which ``f(bpe, ids)`` gives for each text's ids."""
    path = path or default_vocabulary()
    fields = StructType.fromDDL(made).names
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), *fields)]
    x, row = fresh(docs.columns + fields, "bpe_input", "bpe_row")
    df = docs.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(x))
    schema = widened(df.drop(x).schema, made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            out = [f(bpe, bpe.encode(v) if isinstance(v, str) else np.array(v, np.uint32)) for v in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array([o[i] for o in out], k) for i, k in enumerate(arrow))], names=schema.names)

    bpe = load(path)
    by_halves = F.length(x) > LONG_TEXT
    for special in bpe.special:
        by_halves = by_halves & ~F.contains(x, F.lit(special))
    if bpe.fast is None:
        return df.mapInArrow(run, schema)
    long = cut(df.where(by_halves).withColumn(row, F.monotonically_increasing_id()), "bpe_long")
    ids = encode_long(long.select(F.col(row).alias("row"), F.col(x).alias("text")), path).select(F.col("row").alias(row), "ids")
    joined = long.drop(x).join(ids.withColumnRenamed("ids", x), row).select(*[F.col(f"`{c}`") for c in rest], x)
    return df.where(~by_halves).mapInArrow(run, schema).unionByName(joined.mapInArrow(run, schema))


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` without its text, plus ``ids array<int>``."""
    return _with_ids(docs, text, path, "ids array<int>", lambda bpe, ids: (ids.astype(np.int32),), [pa.list_(pa.int32())])


def decode(docs: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` without its ids, plus ``text string``; null ids give an empty text."""
    path = path or default_vocabulary()
    rest = [c for c in docs.columns if c.lower() not in (ids.lower(), "text")]
    (x,) = fresh([*docs.columns, "text"], "bpe_input")
    df = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{ids}`").alias(x))
    schema = widened(df.drop(x).schema, "text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([bpe.decode(v or []) for v in b.column(b.num_columns - 1).to_pylist()], pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def digests(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """The other columns plus ``n_tokens, ids_sha256, decoded_sha256`` of an encoding and its decoding."""

    def both(bpe: Bpe, ids: np.ndarray) -> tuple:
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()

    return _with_ids(docs, text, path, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", both, [pa.int64(), pa.string(), pa.string()])


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
