"""Line-first cleaning, with DataFrame functions alone.

Every line is judged by punctuation, navigation and boilerplate rules; failing
lines are removed, and a document that loses too much of its text is rejected.
Document statistics (word characters, symbols, repeated lines and three-word
windows) add base rules.

Every array step is a column of its own that the next step uses as the argument
of a higher-order function, never inside a lambda, so that nothing is computed
once per element that could be computed once per row.

Null text counts as empty: no words, which fails the base rule of 50 words.
Repeated rows are judged alike, and an empty table gives none.  Very long texts
are judged whole.  Columns named as those made here are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh

SYMBOLS = "#*$%&|<>"

#: Phrases of page furniture, lower case. Fixed values.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "click here",
    "read more",
    "sign up",
    "log in",
    "subscribe to",
    "enable javascript",
    "back to top",
    "skip to content",
    "share on",
    "lorem ipsum",
)


@dataclass(frozen=True)
class QualityRules:
    """Thresholds. ``max_lost`` is the share of word characters that removed lines may hold."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_lost: float = 0.5
    line_max_odd_share: float = 0.1
    line_max_repeated_marks: int = 2


def line_verdict(line: Column, low: Column, rules: QualityRules) -> Column:
    """True where a line stays (``low``: the line in lower case).  Blank lines stay: they hold nothing to lose."""
    marks = "|<>»›•·"
    ends = line.rlike(r"[.!?:;,…。！？)\]\"'”’»][\x20\x09-\x0D]*$")
    short = ~line.rlike(r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){3}[^\x20\x09-\x0D]")
    navigation = (~ends & (short | line.rlike(f"[{marks}]"))) | line.rlike(f"[{marks}][^{marks}]*+[{marks}]")
    odd = F.length(F.regexp_replace(line, r"[^#*$%&|<>!?{}\[\]\\^~=_@]++", ""))
    punctuation = (odd > rules.line_max_odd_share * F.length(line)) | line.rlike(f"(?:[!?]{{2}}[!?]*+[^!?]*+){{{rules.line_max_repeated_marks + 1}}}")
    boiler = F.lit(False)
    for phrase in BOILERPLATE:
        boiler = boiler | F.contains(low, F.lit(phrase))
    return ~line.rlike(f"[^{SPACES}]") | ~(navigation | punctuation | boiler)


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """``docs`` plus ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text,
    lost_chars, kept``; columns of these names in ``docs`` are replaced.

    ``clean_text`` is the text without its failing lines, also for rejected documents.
    """
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "lost_chars", "kept"]
    own = [c for c in docs.columns if c.lower() not in out]
    keep = [F.col(f"`{c}`") for c in own]
    t, w, z, h, dup, s, eq, at, ln, low, good = fresh(own + out, *"q_text q_words q_zip q_hash q_dup q_sorted q_eq q_at q_lines q_low q_good".split())
    c = F.col
    df = docs.select(*keep, F.coalesce(c(f"`{text}`").cast("string"), F.lit("")).alias(t))
    df = df.select(*keep, t, F.filter(F.split(c(t), f"[{SPACES}]+", -1), lambda x: x != "").alias(w), F.split(c(t), "\n", -1).alias(ln), F.split(F.lower(t), "\n", -1).alias(low))
    n = F.size(w)
    from_place = lambda x, k: F.slice(x, k, F.greatest(n, F.lit(1)))
    df = df.select(
        *keep, ln, low, w, n.cast("long").alias("n_words"),
        F.filter(ln, lambda x: x.rlike(f"[^{SPACES}]")).alias(good),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, f"[^{SYMBOLS}]++", "")).cast("long").alias("n_symbols"),
        F.transform(w, lambda x: F.xxhash64(x)).alias(h),
    )
    df = df.select(
        *keep, "n_words", "word_chars", "n_symbols", w,
        F.slice(F.zip_with(F.zip_with(h, from_place(h, 2), lambda x, y: F.xxhash64(x, y)), from_place(h, 3), lambda x, y: F.xxhash64(x, y)), 1, F.greatest(n - 2, F.lit(0))).alias(h),
        (F.size(good) - F.size(F.array_distinct(good))).cast("long").alias("n_dup_lines"),
        F.array_join(F.transform(F.filter(F.zip_with(ln, low, lambda x, y: F.struct(x.alias("l"), line_verdict(x, y, rules).alias("g"))), lambda x: x["g"]), lambda x: x["l"]), "\n").alias("clean_text"),
    )
    # hashes that occur twice only choose the windows whose words are then compared
    df = df.withColumn(eq, F.sort_array(h))
    df = df.withColumn(dup, F.array_distinct(F.filter(F.zip_with(eq, F.slice(eq, 2, F.greatest(F.size(eq), F.lit(1))), lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())))
    windows = F.slice(F.arrays_zip(c(w).alias("a"), from_place(w, 2).alias("b"), from_place(w, 3).alias("c"), F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))).alias("p"), c(h).alias("h")), 1, F.greatest(n - 2, F.lit(0)))
    f1, f2, f3, f4, f5 = (f.name for f in df.select(windows.alias(z)).schema[z].dataType.elementType.fields)
    chosen = F.when(F.size(dup) == 0, F.slice(windows, 1, 0)).when(F.size(dup) <= 32, F.filter(windows, lambda x: F.array_contains(dup, x[f5]))).otherwise(windows)
    df = df.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "clean_text", F.sort_array(chosen).alias(s))
    same = lambda x, y: F.coalesce((x[f1] == y[f1]) & (x[f2] == y[f2]) & (x[f3] == y[f3]), F.lit(False))
    df = df.withColumn(at, F.transform(s, lambda x: x[f4])).withColumn(eq, F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), same))
    hit = F.transform(
        F.filter(
            F.zip_with(c(at), F.zip_with(c(eq), F.concat(F.array(F.lit(False)), c(eq)), lambda x, y: F.coalesce(x, F.lit(False)) | y), lambda p, e: F.struct(p.alias("p"), e.alias("e"))),
            lambda x: x["e"] & x["p"].isNotNull(),
        ),
        lambda x: x["p"],
    )
    df = df.withColumn(at, hit)
    df = df.select(
        *keep, "n_words", "n_dup_lines", "word_chars", "n_symbols", "clean_text",
        F.size(F.array_distinct(F.flatten(F.array(c(at), F.transform(at, lambda x: x + 1), F.transform(at, lambda x: x + 2))))).cast("long").alias("n_repeat_words"),
    )
    failed = (c("n_words") < rules.min_words) | (100 * c("n_repeat_words") > rules.max_repeat_percent * c("n_words"))
    lost = (c("word_chars") - F.length(F.regexp_replace("clean_text", f"[{SPACES}]+", ""))).cast("long")
    made = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "clean_text", lost.alias("lost_chars"))
    # rows of a generator: filters stay above them, where else each would compute the columns it needs once more
    df = df.select(*keep, F.inline(F.array(made)))
    return df.withColumn("kept", ~c("base_failed") & (c("lost_chars") <= rules.max_lost * c("word_chars")))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


_MARKS = "|<>»›•·"
OP8_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{SPACES}]+') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), p AS (
  SELECT rn, i, array_to_string(w[i:i + 2], ' ') AS win FROM (SELECT rn, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT rn, win FROM p GROUP BY rn, win HAVING count(*) > 1
), covered AS (
  SELECT rn, count(*) AS n FROM (SELECT DISTINCT rn, unnest(range(i, i + 3)) AS j FROM p SEMI JOIN twice USING (rn, win)) GROUP BY rn
), l AS (
  SELECT rn, line, regexp_matches(line, '[^{SPACES}]') AS full_line, lower(line) AS low,
    regexp_matches(line, '[.!?:;,…。！？)\]"''”’»][{SPACES}]*$') AS ends
  FROM (SELECT rn, unnest(lines) AS line FROM d)
), judged AS (
  SELECT *, full_line AND (
    (NOT ends AND (NOT regexp_matches(line, '(?:[^{SPACES}]+[{SPACES}]+){{3}}[^{SPACES}]') OR regexp_matches(line, '[{_MARKS}]')))
    OR regexp_matches(line, '[{_MARKS}][^{_MARKS}]*[{_MARKS}]')
    OR length(regexp_replace(line, '[^#*$%&|<>!?{{}}\[\]\\^~=_@]+', '', 'g')) > 0.1 * length(line)
    OR regexp_matches(line, '(?:[!?]{{2}}[!?]*[^!?]*){{3}}')
    OR {" OR ".join(f"contains(low, '{x}')" for x in BOILERPLATE)}
  ) AS failed FROM l
), ls AS (
  SELECT rn, count(*) FILTER (full_line) - count(DISTINCT line) FILTER (full_line) AS n_dup_lines,
    CAST(coalesce(sum(length(regexp_replace(line, '[{SPACES}]+', '', 'g'))) FILTER (failed), 0) AS BIGINT) AS lost_chars FROM judged GROUP BY rn
), f AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols, ls.n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, ls.lost_chars
  FROM d JOIN ls USING (rn) LEFT JOIN covered USING (rn)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT *, NOT base_failed AND lost_chars <= 0.5 * word_chars AS kept FROM b
"""
