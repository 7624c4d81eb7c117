"""URL filter: host and path rules first, gradient-boosted trees for the rest.

Rules give the labels: URLs that a rule decides train the trees on lexical
features alone, and the trees decide the URLs that no rule fits.  Suffix
statistics (smoothed share of blocked URLs by last host label, second-level
domain and file extension) are counted over all labelled rows into a fixed
number of hashed buckets, so what is broadcast has a fixed size.  They are out of
fold: domains are dealt into folds, and a URL's statistics, in training as in
judging, come from the labels of the other folds.  So a domain's own labels never
tell its own verdict, and a rule for one path of it says nothing of the rest.

The trees are fitted on at most ``max_train_rows`` different labelled URLs, those
with the smallest hashes.  Null URLs, or URLs without ``://``, have an empty host and
path and are judged by the same features.  If no URL is labelled, or all labels
agree, the trees return that share (nothing labelled: allow).  A probability of
exactly the threshold blocks.  Repeated URLs get the same verdict and train once;
very long ones are judged whole.  Columns named as those made here are replaced,
others keep their names; an empty table gives none.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, fresh, read_table

SUFFIX_BUCKETS = 1024
FOLDS = 5

#: The rules of the registered query. Fixed values.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = F.regexp_extract(rest, r"^([^/?#]*+)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)
    return F.coalesce(F.translate(host, ASCII_UPPER, ASCII_LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def suffix_buckets(host: str, path: str) -> tuple[int, int, int]:
    labels = host.split(":")[0].split(".")
    last = path.rsplit("/", 1)[-1]
    ext = last.rsplit(".", 1)[-1] if "." in last else ""
    return tuple(zlib.crc32(f"{i}:{x}".encode("utf-8", "replace")) % SUFFIX_BUCKETS for i, x in enumerate((labels[-1], ".".join(labels[-2:]), ext[:16])))


def fold_of(host: str) -> int:
    """The fold of a host's domain."""
    return zlib.crc32(".".join(host.split(":")[0].split(".")[-2:]).encode("utf-8", "replace")) % FOLDS


def out_of_fold(seen: np.ndarray) -> np.ndarray:
    """Rates by fold, kind and bucket from the counts (fold, kind, bucket, label) of the other folds."""
    others = seen.sum(axis=0) - seen
    return (others[..., 1] + 5) / (others.sum(axis=-1) + 10)


def features(url: str, host: str, path: str, rates: np.ndarray) -> list[float]:
    """Lexical features; ``rates`` are the suffix statistics by fold, kind and bucket."""
    rates = rates[fold_of(host)]
    n = max(1, len(url))
    counts = Counter(url)
    query = url.partition("?")[2].partition("#")[0]
    parts = [x for x in path.split("/") if x]
    return [
        len(url), len(host), len(path), len(query),
        len(parts), host.count("."), max(map(len, parts), default=0),
        sum(map(str.isdigit, url)) / n, sum(map(str.isdigit, host)) / max(1, len(host)),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        query.count("&") + bool(query), query.count("="), url.count("-") + url.count("_"), url.count("%"),
        float("#" in url), float("@" in host), float(url.startswith("https")), float(path.endswith("/")), float(bool(re.search(r"\.\w{1,5}$", path))),
        *(rates[i, k] for i, k in enumerate(suffix_buckets(host, path))),
    ]


@dataclass
class BoostedTrees:
    """Second-order boosting of depth-limited trees on quantile bins, for the logistic loss."""

    trees: int = 30
    depth: int = 4
    bins: int = 32
    rate: float = 0.2
    ridge: float = 1.0
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    nodes: list[dict[int, tuple[int, int]]] = field(default_factory=list)
    leaves: list[dict[int, float]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-4), 1 - 1e-4)
        self.base = math.log(share / (1 - share))
        if not len(y) or y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, f = self._binned(x), np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, p * (1 - p)
            at, splits, leaves = np.ones(len(y), np.int64), {}, {}
            for level in range(self.depth + 1):
                for node in np.unique(at[at >= 1 << level]):
                    rows = np.flatnonzero(at == node)
                    gs, hs = g[rows].sum(), h[rows].sum()
                    best = (1e-6, -1, -1)
                    if level < self.depth:
                        for j in range(x.shape[1]):
                            k = len(self.edges[j]) + 1
                            gl = np.bincount(b[rows, j], g[rows], k).cumsum()[:-1]
                            hl = np.bincount(b[rows, j], h[rows], k).cumsum()[:-1]
                            gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                            gain[(hl < 0.5) | (hs - hl < 0.5)] = -1
                            if len(gain) and gain.max() > best[0]:
                                best = (float(gain.max()), j, int(gain.argmax()))
                    if best[1] < 0:
                        leaves[int(node)] = -self.rate * gs / (hs + self.ridge)
                        f[rows] += leaves[int(node)]
                        at[rows] = -node
                    else:
                        splits[int(node)] = best[1:]
                        at[rows] = 2 * node + (b[rows, best[1]] > best[2])
            self.nodes.append(splits)
            self.leaves.append(leaves)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        f = np.full(len(x), self.base)
        if self.nodes and len(x):
            b = self._binned(x)
            for splits, leaves in zip(self.nodes, self.leaves, strict=True):
                at = np.ones(len(x), np.int64)
                for node in sorted(splits):
                    rows = np.flatnonzero(at == node)
                    j, k = splits[node]
                    at[rows] = 2 * node + (b[rows, j] > k)
                for node, value in leaves.items():
                    f[at == node] += value
        return 1 / (1 + np.exp(-f))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", max_train_rows: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """``pages`` plus ``host, path, rule, verdict, block_score`` (null where a rule decides)."""
    spark = pages.sparkSession
    made = ["host", "path", "rule", "verdict", "block_score"]
    rest = [c for c in pages.columns if c.lower() not in made]
    (u,) = fresh(pages.columns + made, "url_to_judge")
    host, path = host_and_path(F.col(u))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    df = pages.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{url}`").cast("string").alias(u)).withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("verdict", verdict)
    labelled = df.where("rule IS NOT NULL").select(F.coalesce(u, F.lit("")).alias("u"), "host", "path", (F.col("verdict") == "block").cast("int").alias("y"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((FOLDS, 3, SUFFIX_BUCKETS, 2), np.int64)
        for b in batches:
            for h, p, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                f = fold_of(h)
                for i, k in enumerate(suffix_buckets(h, p)):
                    seen[f, i, k, y] += 1
        at = np.flatnonzero(seen.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen.ravel()[at])], names=["at", "n"])

    seen = np.zeros(FOLDS * 3 * SUFFIX_BUCKETS * 2)
    for r in labelled.select("host", "path", "y").mapInArrow(suffixes, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 30 x 1024 rows
        seen[r["at"]] = r["n"]
    seen = seen.reshape(FOLDS, 3, SUFFIX_BUCKETS, 2)
    rates, n_labelled = out_of_fold(seen), int(seen[:, 0].sum())

    def to_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns[:3]), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([features(*x, rates) for x in rows], pa.list_(pa.float64())), b.column(3), b.column(4)], names=["x", "y", "at"])

    # twice the share needed is taken by hash, each URL once, so that tasks send few rows
    share = min(1.0, 2 * max_train_rows / max(1, n_labelled))
    placed = labelled.withColumn("at", F.pmod(F.xxhash64("u", F.lit(29)), F.lit(1 << 40))).where(F.col("at") < int(share * (1 << 40))).dropDuplicates(["u", "y"])
    train = placed.mapInArrow(to_features, "x array<double>, y int, at long").orderBy("at", "x").limit(max_train_rows).collect()
    model = BoostedTrees().fit(np.array([r["x"] for r in train], np.float64), np.array([r["y"] for r in train], np.float64)) if train else BoostedTrees(base=-5.0)
    shared = spark.sparkContext.broadcast((model, rates))
    schema = df.drop(u).schema.add("block_score", "double")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, rate = shared.value
        for b in batches:
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            urls, hosts, paths, found = (cols[k].to_pylist() for k in (u, "host", "path", "verdict"))
            todo = [i for i, v in enumerate(found) if v is None]
            score: list[float | None] = [None] * len(found)
            if todo:
                p = trees.predict(np.array([features(urls[i] or "", hosts[i], paths[i], rate) for i in todo], np.float64))
                for i, x in zip(todo, p.tolist(), strict=True):
                    score[i], found[i] = x, "block" if x >= threshold else "allow"
            cols |= {"verdict": pa.array(found, pa.string()), "block_score": pa.array(score, pa.float64())}
            yield pa.RecordBatch.from_arrays([cols[k] for k in schema.names], names=schema.names)

    return df.mapInArrow(judge, schema)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")
