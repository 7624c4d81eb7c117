"""References, capabilities, grants and requests as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import OwnerFold, ReplayFold, fold

#: Capabilities in canonical order. Fixed values.
CAPABILITIES = ("read", "push-objects", "write-refs", "delegate", "wipe", "admin")
DELEGABLE = ("read", "push-objects")


def latest(log: DataFrame, name: str, order: list[str], action: str) -> DataFrame:
    """The last entry of each name, without names whose last entry is a delete."""
    w = Window.partitionBy(name).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("nth", F.row_number().over(w)).where((F.col("nth") == 1) & (F.col(action) != "delete")).drop("nth")


def overwrite_outcomes(writes: DataFrame, name: str, order: list[str], signer: str, created: str, record: str, admin: str) -> DataFrame:
    """``writes`` plus ``outcome``: 204, 403 or 409 against the record stored when each arrives."""
    return fold(writes, OwnerFold(), [name], order, [signer, created, record, admin], "outcome")


def replays(requests: DataFrame, key: list[str], at: str, window: int, order: list[str]) -> DataFrame:
    """``requests`` plus ``replay`` (0 or 1): seen within twice the window since the first accepted sighting."""
    return fold(requests, ReplayFold(2 * window), key, order, [at], "replay")


def allows(caps: Column, wanted: Column | str) -> Column:
    """Whether an array of capabilities includes one; admin includes all."""
    return F.array_contains(caps, "admin") | F.array_contains(caps, wanted)


def shown(caps: Column) -> Column:
    """Capabilities in canonical order, comma-joined; admin stands for all."""
    known = F.filter(F.array(*[F.lit(c) for c in CAPABILITIES]), lambda c: F.array_contains(caps, c))
    return F.when(F.array_contains(caps, "admin"), "admin").otherwise(F.array_join(known, ","))


def grant_error(caps: Column, subject: Column, key: Column, issued: Column, expires: Column, now: Column, window: int) -> Column:
    """Why a grant doesn't hold, or null: caps, subject, early or expired."""
    good = (F.size(caps) > 0) & F.forall(caps, lambda c: c.isin(*DELEGABLE))
    return F.when(~good, "caps").when(~subject.eqNullSafe(key), "subject").when(now < issued - window, "early").when(now > expires + window, "expired")


def in_window(at: Column, now: Column, window: int) -> Column:
    return F.abs(at - now) <= window


def pending(entries: DataFrame, done: DataFrame, root: str, entry: str) -> DataFrame:
    """Number of unprocessed inbox entries of each root: a reference to the root waits until it is 0."""
    open_ = entries.join(done.select(entry).distinct().withColumn("is_done", F.lit(True)), entry, "left")
    return open_.groupBy(root).agg(F.count_if(F.col("is_done").isNull()).alias("pending"))


def oldest_open(spans: DataFrame, start: str, end: str) -> DataFrame:
    """Start of the oldest write still in flight."""
    return spans.where(F.col(end).isNull()).agg(F.min(start).alias("oldest"))


def allow_list(lines: DataFrame, text: str = "value", position: str = "pos") -> DataFrame:
    """Rows ``key, caps`` of authorized-keys lines: ``[caps="a,b"] type base64 [comment]``.

    Blank lines and comments are skipped, the last line of a key wins, and a
    line without options has read, push-objects and write-refs.  A line that
    doesn't parse, or names an unknown capability, has null caps.
    """
    known = lines.where(F.trim(text) != "").where(~F.trim(text).startswith("#"))
    option = F.regexp_extract(text, r'^\s*(?:[a-z]+=)?"([^"]*)"\s+', 1)
    key = F.regexp_extract(text, r"((?:ssh|ecdsa|sk)-[A-Za-z0-9@.-]+\s+[A-Za-z0-9+/=]+)", 1)
    caps = F.when(option == "", F.array(*[F.lit(c) for c in CAPABILITIES[:3]])).otherwise(F.transform(F.split(option, ","), lambda x: F.trim(x)))
    caps = F.when(F.forall(caps, lambda c: c.isin(*CAPABILITIES)) & (key != ""), caps)
    w = Window.partitionBy("key").orderBy(F.desc(position))
    return known.select(F.regexp_replace(key, r"\s+", " ").alias("key"), caps.alias("caps"), position).withColumn("nth", F.row_number().over(w)).where("nth = 1").select("key", "caps")


def issue_error(caps: Column, issued: Column, expires: Column) -> Column:
    """Why a grant can't be issued, or null: caps (none, or one that may not be handed on) or times."""
    good = (F.size(caps) > 0) & F.forall(caps, lambda c: c.isin(*DELEGABLE))
    return F.when(~F.coalesce(good, F.lit(False)), "caps").when(issued > expires, "times")


def issued_caps(caps: Column) -> Column:
    """Capabilities of a grant as it is written: each once, in order."""
    return F.array_join(F.array_sort(F.array_distinct(caps)), ",")


def authorise(requests: DataFrame, allowed: DataFrame) -> DataFrame:
    """``requests`` (key, cap, issuer, granted) plus ``outcome``: own (the key has the capability), grant (its issuer may
    hand it on and did) or denied.  allowed: ``key, caps``.  Both joins are on keys; a list small enough is broadcast by Spark."""
    mine = allowed.select("key", F.col("caps").alias("own_caps"))
    theirs = allowed.select(F.col("key").alias("issuer"), F.col("caps").alias("issuer_caps"))
    both = requests.join(mine, "key", "left").join(theirs, "issuer", "left")
    own = F.coalesce(allows(F.col("own_caps"), F.col("cap")), F.lit(False))
    handed = F.coalesce(allows(F.col("issuer_caps"), "delegate") & F.array_contains("granted", F.col("cap")) & F.col("cap").isin(*DELEGABLE), F.lit(False))
    return both.withColumn("outcome", F.when(own, "own").when(handed, "grant").otherwise("denied")).drop("own_caps", "issuer_caps")


#: Longest signature and public key of a reference, in bytes. Fixed values.
SIGNATURE_BYTES, PUBLIC_KEY_BYTES = 64 << 10, 16 << 10


def record_error(signature_size: Column, key_size: Column) -> Column:
    """Why a reference's record isn't valid, or null: unsigned records have neither, signed ones both."""
    return (
        F.when(signature_size.isNull() != key_size.isNull(), "half_signed")
        .when(signature_size > SIGNATURE_BYTES, "signature")
        .when(key_size > PUBLIC_KEY_BYTES, "public_key")
    )


def spec_parts(spec: Column) -> tuple[Column, Column, Column]:
    """(kind, target, path) of ``ref:NAME[@PATH]`` or ``KEY[/PATH]``: kind is ref, key or bad."""
    is_ref = F.startswith(spec, F.lit("ref:"))
    name, inner = F.regexp_extract(spec, r"(?s)^ref:([^@]*)", 1), F.regexp_extract(spec, r"(?s)^ref:[^@]*@(.*)$", 1)
    key = F.regexp_extract(spec, r"^([0-9a-f]{64})(?:/|$)", 1)
    kind = F.when(is_ref & (name != ""), "ref").when(~is_ref & (key != ""), "key").otherwise("bad")
    return kind, F.when(kind == "ref", name).when(kind == "key", key), F.when(kind == "ref", inner).when(kind == "key", F.substring(spec, 66, 1 << 30))


def resolve_remote(wanted: DataFrame, remotes: DataFrame) -> DataFrame:
    """``wanted`` (owner, name) plus ``url`` and ``outcome``: the remote of that name, or the owner's only one if the name is
    null; else missing or ambiguous.  remotes: ``owner, name, url``."""
    named = remotes.select("owner", "name", F.col("url").alias("named_url"))
    only = remotes.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("only_url"))
    both = wanted.join(named, ["owner", "name"], "left").join(only, "owner", "left")
    url = F.when(F.col("name").isNotNull(), F.col("named_url")).when(F.col("n") == 1, F.col("only_url"))
    outcome = F.when(url.isNotNull(), "ok").when(F.col("name").isNull() & (F.col("n") > 1), "ambiguous").otherwise("missing")
    return both.withColumn("url", url).withColumn("outcome", outcome).drop("named_url", "n", "only_url")
