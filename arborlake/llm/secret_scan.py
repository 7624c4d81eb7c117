"""Secret scan with DataFrame functions alone: known shapes, and a randomness test battery for the rest.

Known shapes are assignments, access keys and long hexadecimal runs.  Beyond
them, every run of 20 or more characters of an encoding alphabet is a candidate.
Its encoding is inferred (hex, base32, base62, base64), and three tests compare
it with random draws from that alphabet: chi-squared uniformity, Wald-Wolfowitz
runs of character classes, and serial correlation of neighbouring characters.
Fisher's method combines their p-values; a candidate that the combination
rejects is not random.

Short strings can look random by chance.  So the same three statistics also give
p-values under the opposite hypothesis, that the candidate is composed like text
(letter frequencies of prose, few changes of character class, neighbours alike).
They are combined by Stouffer's method, and text of greater length lies further
off, so length counts.  Benjamini-Hochberg within each class of lengths (powers
of two) then bounds the share of false finds; it needs only counts by length
class and score step, at most 64 x 512 numbers.

Positions are code points, end exclusive.  Null text counts as empty: no spans.
Repeated rows are scanned each on its own and count each in the control.  Columns
named ``base`` or ``spans`` are replaced, others keep their names; an empty table
gives none.  Scores that tie at a limit are finds alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, read_table

#: Shapes by kind, in order of listing. Fixed values.  A shape that fails its length is consumed all the same,
#: which matters for assignments only: for the others a minimum count says the same.
ASSIGN = r"""(?=[PpSsTtAa])((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
BLOCK = 128
#: Alphabets: name, shape, symbols; and of text in them: probability that two characters are equal, and that neighbours
#: differ in class. Fixed values.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", 0.2, 0.1),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567", 0.065, 0.1),
    ("base62", r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, 0.065, 0.3),
    ("base64url", r"^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_", 0.065, 0.3),
    ("base64", r"^[A-Za-z0-9+/_-]+$", UPPER + LOWER + DIGITS + "+/", 0.065, 0.3),
)
#: Correlation of neighbours in text, by place in the alphabet. Fixed value.
TEXT_SERIAL = 0.2
#: Least combined p-value of the three tests at which a candidate counts as random.
RANDOM_LEAST = 0.005
#: Polynomial of the complementary error function (Abramowitz and Stegun 7.1.26). Fixed values.
ERFC = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
#: Score steps of the false-discovery count.
STEP, LOWEST, STEPS = 0.125, -16.0, 512


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)


def with_matches(df: DataFrame, text: str, pattern: str, out: str, group: int | None = None) -> DataFrame:
    """Add ``out``, the pattern's matches in order: (start, end, found, length of the group).

    Matches and what lies between them alternate, so starts are running sums of
    their lengths.  The sums are taken by blocks, in linear time but for the
    blocks themselves.  Columns that a lambda needs are referred to outside it
    too, which keeps the optimizer from moving their computation inside.
    """
    m, g, d, e, b, p = fresh(df.columns + [out], *(f"{out}_{x}" for x in "mgdebp"))
    c, one = F.col, F.lit(1)
    keep = df.columns
    df = df.select(*keep, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias(m), F.split(text, pattern, -1).alias(g), *([F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x)).alias(e)] if group else []))
    lengths = F.transform(m, lambda x: F.length(x).cast("long"))
    steps = F.slice(F.zip_with(F.transform(g, lambda x: F.length(x).cast("long")), F.concat(F.array(F.lit(0).cast("long")), lengths), lambda x, y: x + y), one, F.size(m))
    df = df.select(*keep, m, *([e] if group else []), steps.alias(d))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(d) / BLOCK).cast("int")), lambda i: _sum(F.slice(d, i * BLOCK + 1, F.lit(BLOCK))))
    df = df.select(*keep, m, *([e] if group else []), d, F.when(F.size(d) > 0, blocks).otherwise(F.array(F.lit(0).cast("long"))).alias(b))
    df = df.select(*keep, m, *([e] if group else []), d, F.when(F.size(b) > 0, F.transform(b, lambda _, i: _sum(F.slice(b, one, i)))).alias(p))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    starts = F.when((F.size(p) > 0) & (F.size(d) > 0), F.transform(d, lambda _, i: F.get(p, block(i)) + _sum(F.slice(d, block(i) * BLOCK + 1, i % BLOCK + 1)))).otherwise(F.slice(d, one, F.lit(0)))
    size = F.transform(m, lambda x: F.length(x)) if not group else c(e)
    zipped = F.arrays_zip(starts.alias("s"), c(m).alias("m"), size.alias("z"))
    f1, f2, f3 = (f.name for f in df.select(zipped.alias("x")).schema["x"].dataType.elementType.fields)
    made = F.transform(zipped, lambda x: F.struct(x[f1].alias("start"), (x[f1] + F.length(x[f2])).alias("stop"), x[f2].alias("found"), x[f3].cast("long").alias("size")))
    return df.select(*keep, made.alias(out))


def two_sided(z: Column) -> Column:
    """p-value of a standard normal deviate, either way; at least the smallest positive double that logarithms bear."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + ERFC[0] * x)
    poly = t * (ERFC[1] + t * (ERFC[2] + t * (ERFC[3] + t * (ERFC[4] + t * ERFC[5]))))
    return F.greatest(poly * F.exp(-x * x), F.lit(1e-300))


def score(token: Column) -> Column:
    """(random: combined p-value of the tests, score: combined deviate from text, length class) of a candidate, as a struct."""
    s = F.rtrim(token, F.lit("="))
    n = F.length(s).cast("double")
    chars = F.filter(F.split(s, "", -1), lambda x: x != "")
    first, rest = F.slice(chars, F.lit(1), F.length(s) - 1), F.slice(chars, F.lit(2), F.length(s))
    equal_pairs = F.aggregate(F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)).cast("double")), F.lit(0.0), lambda a, b: a + b * b)

    def kind(x: Column) -> Column:
        return F.when(x.rlike("[A-Z]"), 1).when(x.rlike("[a-z]"), 2).when(x.rlike("[0-9]"), 3).otherwise(4)

    changes = F.size(F.filter(F.zip_with(first, rest, lambda x, y: kind(x) != kind(y)), lambda x: x)).cast("double")
    out = F.lit(None).cast("struct<random:double,score:double,class:int>")
    for _, shape, symbols, equal, change_in_text in reversed(ENCODINGS):
        k = len(symbols)
        groups = [sum(ch in g for ch in symbols) for g in (UPPER, LOWER, DIGITS)]
        groups.append(k - sum(groups))
        change = 1 - sum(g * g for g in groups) / (k * k)
        value = lambda x, a=symbols: F.instr(F.lit(a), F.lower(x) if len(a) == 16 else F.translate(x, "+/-_", "-_-_") if a.endswith("-_") else F.translate(x, "-_", "+/")).cast("double")
        chi = F.lit(k) * equal_pairs / n - n
        serial = F.aggregate(F.zip_with(first, rest, lambda x, y: (value(x) - (k + 1) / 2) * (value(y) - (k + 1) / 2)), F.lit(0.0), lambda a, b: a + b) / ((k * k - 1) / 12)
        # deviates from random draws: Wilson and Hilferty's for chi-squared
        cube = 2 / (9 * (k - 1))
        uniform = (F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - cube)) / math.sqrt(cube)
        runs = (changes - change * (n - 1)) / F.sqrt(change * (1 - change) * (n - 1))
        half = -(F.log(two_sided(uniform)) + F.log(two_sided(runs)) + F.log(two_sided(serial / F.sqrt(n - 1))))
        random = F.exp(-half) * (1 + half + half * half / 2)
        # deviates from text
        excess = k * equal - 1
        even = (k - 1 + n * excess - chi) / F.sqrt(2 * (k - 1) + 4 * n * excess)
        mixed = (changes - change_in_text * (n - 1)) / F.sqrt(change_in_text * (1 - change_in_text) * (n - 1))
        apart = (TEXT_SERIAL * (n - 1) - serial) / F.sqrt(n - 1)
        far = (even + mixed + apart) / math.sqrt(3)
        out = F.when(s.rlike(shape), F.struct(random.alias("random"), far.alias("score"), F.floor(F.log2(n)).cast("int").alias("class"))).otherwise(out)
    return out


def false_discovery_limits(candidates: DataFrame, share: float) -> dict[int, float]:
    """Least score by length class, by Benjamini-Hochberg over (class, score) rows; a class without finds is left out.

    A score below the lowest step (not random) has the p-value 1.
    """
    step = F.least(F.greatest(F.floor((F.col("score") - LOWEST) / STEP), F.lit(-1)), F.lit(STEPS)).cast("int")
    rows = candidates.groupBy("class", step.alias("step")).count().collect()  # at most 64 x 514 rows
    limits: dict[int, float] = {}
    for k in {r["class"] for r in rows}:
        counts = {r["step"]: r["count"] for r in rows if r["class"] == k}
        m, above = sum(counts.values()), 0
        for i in sorted(counts, reverse=True):
            above += counts[i]
            # the lowest score of the step stands for all of it
            p = 0.5 * math.erfc((LOWEST + i * STEP) / math.sqrt(2)) if i >= 0 else 1.0
            if p * m <= share * above:
                limits[k] = LOWEST + i * STEP
    return limits


def scan(docs: DataFrame, text: str = "text", keep_text: bool = True, share: float = 0.01) -> DataFrame:
    """``docs`` plus ``base`` and ``spans`` (arrays of (start, rank, stop, kind), in order), where spans are those of
    known shape and the finds of the battery that overlap none of them.  ``share`` bounds the false finds."""
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), "base", "spans")]
    t, a, k, h, r, base, cand = fresh(docs.columns + ["base", "spans"], *"scan_text scan_assign scan_access scan_hex scan_run scan_base scan_candidates".split())
    keep = [F.col(f"`{c}`") for c in rest]
    df = docs.select(*keep, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(t))
    for name, pattern, group in ((a, ASSIGN, 2), (k, ACCESS, None), (h, HEX, None), (r, CANDIDATE, None)):
        df = with_matches(df, t, pattern, name, group)
    named = lambda x, rank, kind: F.transform(x, lambda y: F.struct(y["start"].alias("start"), F.lit(rank).alias("rank"), y["stop"].alias("stop"), F.lit(kind).alias("kind")))
    long_enough = F.filter(a, lambda x: x["size"] >= ASSIGN_LEAST)
    df = df.select(*keep, t, r, F.sort_array(F.concat(named(long_enough, 1, "assign"), named(k, 2, "access"), named(h, 3, "hex"))).alias(base))
    apart = F.when(
        F.size(base) >= 0,
        F.filter(r, lambda x: ~F.exists(base, lambda y: (y["start"] < x["stop"]) & (y["stop"] > x["start"]))),
    )
    scored = F.transform(apart, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), score(x["found"]).alias("test")))
    df = cut(df.select(*keep, *([t] if keep_text else []), base, F.filter(scored, lambda x: x["test"]["random"].isNotNull()).alias(cand)), "scanned")
    tests = df.select(F.explode(cand).alias("x")).select(F.col("x.test.class").alias("class"), F.when(F.col("x.test.random") >= RANDOM_LEAST, F.col("x.test.score")).otherwise(LOWEST - 1).alias("score"))
    limits = false_discovery_limits(tests, share)
    enough = lambda x: F.coalesce(sum((F.when(x["test"]["class"] == c, F.lit(v)).otherwise(F.lit(0.0)) for c, v in limits.items()), F.lit(0.0)) <= x["test"]["score"], F.lit(False)) & x["test"]["class"].isin(list(limits))
    finds = F.filter(cand, lambda x: (x["test"]["random"] >= RANDOM_LEAST) & enough(x)) if limits else F.slice(cand, 1, 0)
    out = df.withColumn("spans", F.sort_array(F.concat(F.col(base), named(finds, 4, "random")))).withColumnRenamed(base, "base")
    return out.select(*keep, *([F.col(t).alias(text)] if keep_text else []), "base", "spans")


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def redact(scanned: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The text of a scan with its spans replaced, overlapping ones by one mark."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= acc["at"], F.array(F.substring(F.col(text), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    done = F.aggregate("spans", begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(text))))
    return scanned.withColumn(text, F.when(F.size("spans") > 0, done).otherwise(F.col(text)))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
