"""Canonical exact fingerprints, in DataFrame functions alone.

A text's canonical form is its NFKC form, case-folded, composed again, with each run of white space as one
space and none at the ends (the two Unicode steps call the ICU library on Spark's class path by
``reflect``). Its fingerprint is 128 bits of xxhash64 under two seeds. Hashes that occur more than once form
buckets, in which the canonical bytes are compared (lowest against highest); if they differ, the bucket's
members get the rank of their bytes as a suffix, so that fingerprints are equal exactly if canonical texts
are. The likeness of two such fingerprints is 1 if they are equal, else 0.

Defined cases: a null text is empty; texts are read whole; only ``doc_id`` and ``text`` are read; repeated
rows have equal fingerprints; a null doc_id counts as the lowest; rows with equal doc_id stand in descending
order of their texts or, where very many share it, of a hash of their texts and then of the texts; the only row
of a table is its own next one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annoloom.llm.common import materialise

#: Buckets of repeated hashes up to this many are broadcast; more are joined by a shuffle.
BROADCAST_HASHES = 1_000_000
ROWS_PER_RANGE, MAX_RANGES = 1024, 16_384
_LOWEST = -(1 << 63)


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True))
    return F.trim(F.regexp_replace(compose(folded), r"(?U)\s+", " "))


def wide_hash(canon: Column, bits: int = 128) -> Column:
    """Two seeded 64-bit hashes in hexadecimal; fewer ``bits`` only to test what collisions do."""
    both = F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0") for seed in (1, 2)])
    return F.right(both, F.lit(bits // 4)) if bits < 128 else both


def likeness(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(0.0)


def _distinguish(forms: DataFrame, hashes: DataFrame) -> DataFrame | None:
    """Byte comparison inside equal buckets. ``forms`` has (h, canon), with repeated rows; ``hashes`` the h of
    the same rows. Returns (h, canon, rank) of the buckets that hold unlike texts, or None."""
    repeated = materialise(hashes.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeated")
    few = repeated.count() <= BROADCAST_HASHES
    suspects = forms.join(F.broadcast(repeated) if few else repeated, "h", "left_semi")
    spread = suspects.groupBy("h").agg(F.min("canon").alias("low"), F.max("canon").alias("high"))
    collided = materialise(spread.filter("low <> high").select("h"), "collided")
    if collided.isEmpty():
        return None
    unlike = suspects.join(collided, "h", "left_semi").distinct()
    return unlike.withColumn("rank", F.dense_rank().over(Window.partitionBy("h").orderBy("canon")))


def _named(rows: DataFrame, ranks: DataFrame | None, h: str, canon: str, name: str) -> DataFrame:
    """Add fingerprint ``name`` from hash ``h`` and, in buckets with unlike texts, the rank of ``canon``."""
    if ranks is None:
        return rows.withColumn(name, F.col(h))
    ranks = ranks.select(F.col("h").alias(h), F.col("canon").alias(canon), F.concat(F.lit("-"), F.col("rank").cast("string")).alias("_rank"))
    return rows.join(ranks, [h, canon], "left").withColumn(name, F.concat(h, F.coalesce("_rank", F.lit("")))).drop("_rank")


def fingerprint_documents(docs: DataFrame, bits: int = 128) -> DataFrame:
    """(doc_id, fingerprint) for every row."""
    rows = docs.select("doc_id", canonical(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("canon"))
    rows = rows.withColumn("h", wide_hash(F.col("canon"), bits))
    ranks = _distinguish(rows.select("h", "canon"), rows.select("h"))
    return _named(rows, ranks, "h", "canon", "fingerprint").select("doc_id", "fingerprint")


def with_next(docs: DataFrame, bits: int = 128) -> DataFrame:
    """(doc_id, text, h, next_text, next_h): the text and hash of the next row in descending order of doc_id (rows
    of equal doc_id as the module says); after the last comes the first. Rows are dealt by
    ranges of that order, so that no doc_id, null neither, is one task's load; of each range the highest row, at
    most ``MAX_RANGES`` in all, is fetched apart for the lowest row of the range above."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(_LOWEST)))
    count = rows.count()
    ranges = max(1, min(MAX_RANGES, ceil(count / ROWS_PER_RANGE)))
    shares = [(i + 1) / ranges for i in range(ranges)]
    found = rows.agg(F.percentile_approx("k", shares, max(10_000, 4 * ranges)).alias("q"), F.max("k").alias("top")).first()
    often = Counter(found["q"] or [])
    tops = sorted({*often, *([found["top"]] if found["top"] is not None else [])}) or [0]
    # a doc_id that is several quantiles has ranges of its own, by hash, above that of the lower ones
    parts = [often[t] if often[t] > 1 else 0 for t in tops]
    offsets = [0, *accumulate(p + 1 for p in parts)][:-1]
    n, step = len(tops), ceil(sqrt(len(tops)))
    longs = lambda xs: F.lit(xs).cast("array<long>")
    below = lambda xs: F.size(F.filter(xs, lambda t: t < F.col("k")))
    rows = rows.withColumn("coarse", below(longs(tops[step - 1 :: step] or [tops[-1]])))
    rows = rows.withColumn("i", F.least(F.lit(n), F.col("coarse") * step + below(F.slice(longs(tops), F.col("coarse") * step + 1, F.lit(step))) + 1))
    own = F.element_at(longs(parts), F.col("i"))
    z = F.when((own > 0) & (F.element_at(longs(tops), F.col("i")) == F.col("k")), F.pmod(F.xxhash64("text"), F.lit(1 << 31)))
    rows = rows.withColumn("z", z).withColumn("range", F.element_at(longs(offsets), F.col("i")) + F.coalesce(1 + F.floor(F.col("z") * own / float(1 << 31)), F.lit(0)))
    rows = rows.drop("coarse", "i").withColumn("z", F.coalesce("z", F.lit(-1).cast("long")))

    highest = {r["range"]: r["top"] for r in rows.groupBy("range").agg(F.max(F.struct("k", "z")).alias("top")).collect()}
    present = sorted(highest)
    facts = {"range": present, "k": [highest[r]["k"] for r in present], "z": [highest[r]["z"] for r in present], "above": present[1:] + present[:1]}
    above = docs.sparkSession.range(1).select(F.inline(F.arrays_zip(*[longs(xs).alias(c) for c, xs in facts.items()])))
    hashed = lambda df: df.withColumn("h", wide_hash(canonical(F.col("text")), bits))
    heads = rows.select("range", "k", "z", "text").join(F.broadcast(above), ["range", "k", "z"]).groupBy("above").agg(F.max("text").alias("head_text"))
    heads = heads.select(F.col("above").alias("range"), "head_text", wide_hash(canonical(F.col("head_text")), bits).alias("head_h"))
    order = Window.partitionBy("range").orderBy(F.desc("k"), F.desc("z"), F.desc("text"))
    rows = hashed(rows).withColumn("next_text", F.lead("text").over(order)).withColumn("next_h", F.lead("h").over(order))
    rows = rows.join(heads, "range", "left")
    return rows.select("doc_id", "text", "h", F.coalesce("next_text", "head_text").alias("next_text"), F.coalesce("next_h", "head_h").alias("next_h"))


def report(docs: DataFrame, bits: int = 128) -> DataFrame:
    """Fingerprints of every text and of its edited form (its last third replaced by the start of the next
    text), and their likeness to the edit's and to the next text's. The edited texts are never kept: where
    their hashes occur more than once they are made again."""
    third = "cast(floor(length(text) / 3) as int)"
    edited = F.concat(F.expr(f"left(text, length(text) - {third})"), F.expr(f"left(next_text, {third})"))
    rows = with_next(docs, bits).withColumn("edited", edited).withColumn("edited_canon", canonical(F.col("edited")))
    rows = rows.withColumn("edited_h", wide_hash(F.col("edited_canon"), bits))
    own = ["doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "h", "edited_h", "next_h"]
    kept = materialise(rows.select(*own), "fingerprints")
    hashes = kept.select(F.explode(F.array("h", "edited_h")).alias("h"))
    texts = docs.select(canonical(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("canon"))
    forms = texts.select(wide_hash(F.col("canon"), bits).alias("h"), "canon").unionByName(rows.select(F.col("edited_h").alias("h"), F.col("edited_canon").alias("canon")))
    ranks = _distinguish(forms, hashes)
    if ranks is not None:
        kept = rows.select(*own, canonical(F.col("text")).alias("canon"), "edited_canon", canonical(F.col("next_text")).alias("next_canon"))
    named = _named(kept, ranks, "h", "canon", "fingerprint")
    named = _named(named, ranks, "edited_h", "edited_canon", "edited_fingerprint")
    named = _named(named, ranks, "next_h", "next_canon", "next_fingerprint")
    return named.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
