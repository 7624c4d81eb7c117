"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased per code point, everything but letters becomes a single
space, and n-grams of one to three characters are hashed into a fixed number of
buckets.  Counts are taken on the executors and only their fixed-size sums reach
the driver.  The log-probability matrix (buckets x languages, 256 KB a language)
is broadcast.  Texts are scored in batches: the n-grams of all texts of a batch
are counted as a sparse matrix (text, bucket, count), whose product with the
log-probabilities is summed by text.

The model is fitted on a bounded sample of labelled rows (``max_train_docs``):
of each language the same number of different texts, or all if it has fewer,
chosen by a hash of the text, so that the same ones are taken however the table
is split.  As every language has a text there, the same number bounds the
languages and with them the matrix.  Priors are counted over all labelled rows,
and a language without a letter in its texts is left out.  Prediction covers
every row and every whole text.

Null text, or text without a letter: language ``und`` with score 0.  If nothing
can be learned (no labelled row), every text gets ``und``.  Ties go to the first
language in order.  Repeated rows get the same answer, and train once.  Columns
named as those made here are replaced, others keep their names; an empty table
gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, read_table

ORDERS = (1, 2, 3)
SLICE, BATCH = 1 << 19, 1 << 20
#: Odd multipliers of the hash, one for each place in an n-gram, and the last one to spread it. Fixed values.
PLACES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@cache
def _lower() -> np.ndarray:
    """Code point to lower-case letter, or 32 for everything else."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        if (ch := chr(i)).isalpha():
            low = ch.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _hashed(x: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Buckets of the n-grams of a row of code points."""
    h = np.full(len(x) - n + 1, n, np.uint64)
    for k in range(n):
        h += (x[k : len(x) - n + 1 + k] + np.uint64(1)) * PLACES[k]
        h ^= h >> np.uint64(29)
    h *= PLACES[0]
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def ngram_buckets(text: str | None, bits: int) -> Iterator[np.ndarray]:
    """Bucket numbers of the text's n-grams, slice by slice; nothing if it has no letter."""
    if not text:
        return
    tail = np.zeros(0, np.uint32)
    for at in range(0, len(text), SLICE):
        code = _lower()[np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        if at == 0:
            code = np.concatenate([np.array([32], np.uint32), code])
        if at + SLICE >= len(text):
            code = np.concatenate([code, np.array([32], np.uint32)])
        before = np.concatenate([tail[-1:] if len(tail) else np.zeros(1, np.uint32), code[:-1]])
        code = code[(code != 32) | (before != 32)]
        own, code = len(code), np.concatenate([tail, code])
        new = len(code) - own
        tail = code[-(max(ORDERS) - 1) :]
        for n in ORDERS:
            first = max(0, new - n + 1)
            if len(code) - first < n:
                continue
            x = code[first:].astype(np.uint64)
            h = _hashed(x, n, bits)
            yield h[x != 32] if n == 1 else h


def batch_counts(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the n-grams of many texts, in order of text and bucket."""
    keys, many = [np.zeros(0, np.int64)], []
    short, size = [], 0

    def flush() -> None:
        if not short:
            return
        lengths = np.array([len(t) + 2 for _, t in short])
        code = _lower()[np.frombuffer("".join(f" {t} " for _, t in short).encode("utf-32-le", "surrogatepass"), np.uint32)]
        own = np.repeat([i for i, _ in short], lengths)
        # one space for each run of them within a text
        kept = np.ones(len(code), bool)
        kept[1:] = (code[1:] != 32) | (code[:-1] != 32) | (own[1:] != own[:-1])
        code, own = code[kept].astype(np.uint64), own[kept]
        for n in ORDERS:
            if len(code) >= n:
                h = _hashed(code, n, bits)
                same = own[: len(h)] == own[n - 1 :]
                if n == 1:
                    same &= code != 32
                keys.append((own[: len(h)][same] << bits) | h[same])

    for i, t in enumerate(texts):
        if not t:
            continue
        if len(t) > SLICE:  # slice by slice, so that a very long text takes no more memory than a slice
            row = np.zeros(1 << bits, np.int64)
            for h in ngram_buckets(t, bits):
                row += np.bincount(h, minlength=1 << bits)
            used = np.flatnonzero(row)
            many.append(((i << bits) | used, row[used]))
            continue
        short.append((i, t))
        size += len(t)
        if size > SLICE:
            flush()
            short, size = [], 0
    flush()
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    if many:
        key, count = np.concatenate([key, *(k for k, _ in many)]), np.concatenate([count, *(c for _, c in many)])
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
    return key >> bits, key & ((1 << bits) - 1), count


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray
    bits: int

    def predict_batch(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The likeliest language of each text, ties to the first in order, and its posterior probability."""
        if not self.languages or not texts:
            return [("und", 0.0)] * len(texts)
        if len(texts) > 1 and sum(len(t or "") for t in texts) > BATCH:  # by halves, until a part's n-grams fit in memory
            half = len(texts) // 2
            return self.predict_batch(texts[:half]) + self.predict_batch(texts[half:])
        text, bucket, count = batch_counts(texts, self.bits)
        total = np.tile(self.log_prior, (len(texts), 1))
        step = max(1, (1 << 22) // len(self.languages))
        for lo in range(0, len(text), step):
            own = text[lo : lo + step]
            head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            part = self.log_prob[bucket[lo : lo + step]] * count[lo : lo + step, None]
            total[own[head]] += np.add.reduceat(part, head, axis=0, dtype=np.float64)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(axis=1)
        lettered = np.zeros(len(texts), bool)
        lettered[text] = True  # a bucket of a single letter, at least
        return [(self.languages[b], float(p)) if ok else ("und", 0.0) for b, p, ok in zip(best.tolist(), score.tolist(), lettered.tolist(), strict=True)]

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_batch([text])[0]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", max_train_docs: int = 20_000, bits: int = 16, smoothing: float = 0.1) -> LanguageModel:
    """Learn from the rows of ``docs`` whose language isn't null.

    At most ``max_train_docs`` different texts are taken, at least one of each
    language; beyond that many languages, those of most rows are learned.
    """
    known = docs.select(F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("g")).where("g IS NOT NULL")
    h, lettered = F.shiftrightunsigned(F.xxhash64("t", F.lit(17)), 1), F.col("t").rlike(r"\p{L}")
    sizes = known.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.when(lettered, h)).alias("texts"))
    sizes = sizes.where("texts > 0").orderBy(F.desc("n"), "g").limit(max_train_docs).collect()
    languages = sorted(r["g"] for r in sizes)
    if not languages:
        return LanguageModel([], np.zeros((0, 0)), np.zeros(0), bits)
    # what languages with few texts leave is shared by the others
    most = left = max_train_docs
    for i, r in enumerate(sorted(sizes, key=lambda r: r["texts"])):
        most = max(1, left // (len(sizes) - i))
        if r["texts"] > most:
            break
        left -= r["texts"]
    # candidates are at least ``most`` even where the texts of a language are counted with an error
    spark = docs.sparkSession
    below = spark.createDataFrame([(r["g"], min((1 << 63) - 1, int((2 * most + 30) / r["texts"] * 2.0**63))) for r in sizes], "g string, below long")
    rows = known.where(lettered).withColumn("h", h)
    candidates = rows.join(F.broadcast(below), "g").where("h <= below").select("g", "h").distinct()
    last = candidates.withColumn("nth", F.row_number().over(Window.partitionBy("g").orderBy("h"))).where(F.col("nth") <= most).groupBy("g").agg(F.max("h").alias("last")).collect()
    last = spark.createDataFrame([(r["g"], r["last"]) for r in last], "g string, last long")  # one row a language
    sample = rows.join(F.broadcast(last), "g").where("h <= last").dropDuplicates(["g", "h"]).select("t", "g")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = counts.setdefault(g, np.zeros(1 << bits, np.int64))
                for h in ngram_buckets(t, bits):
                    c += np.bincount(h, minlength=1 << bits)
        if counts:
            yield pa.RecordBatch.from_pydict({"g": list(counts), "c": [zlib.compress(c.tobytes(), 1) for c in counts.values()]}, pa.schema([("g", pa.string()), ("c", pa.binary())]))

    total = np.zeros((len(languages), 1 << bits), np.float64)
    rows_of = {r["g"]: r["n"] for r in sizes}
    seen = np.array([rows_of[g] for g in languages], np.float64)
    at = {g: i for i, g in enumerate(languages)}
    # the sample is bounded, so a fixed number of tasks counts it and a fixed number of vectors arrives here
    for r in sample.repartition(12).mapInArrow(count, "g string, c binary").toLocalIterator():
        total[at[r["g"]]] += np.frombuffer(zlib.decompress(r["c"]), np.int64)
    total += smoothing
    log_prob = np.log(total / total.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()
    return LanguageModel(languages, log_prob, np.log((seen + 1) / (seen + 1).sum()), bits)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``lang_pred`` and ``score``; columns of these names are replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c.lower() != text.lower() and c.lower() not in ("lang_pred", "score")]
    (t,) = fresh([*docs.columns, "lang_pred", "score"], "text_to_score")
    df = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias(t))
    schema = df.drop(t).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            k = b.num_columns - 1
            found = m.predict_batch(b.column(k).to_pylist())
            columns = [*b.columns[:k], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))
    model = fit(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")
