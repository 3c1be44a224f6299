"""Temperature mixing of sources, in DataFrame functions.

A source's weight is its token share to the power ``exponent``, normalised. The exponent is found by
bisection so that the weights reach a target entropy, or so that no source is repeated more often than a
limit. The total budget is given, or the least at which every source is read whole at least once, so nothing is
dropped. A source's budget is realised as permutations of its blocks: one for each full pass, and for the
rest the start of another, whose last block is cut at a document. ``slot`` (0 to 1) orders the result:
read by it, every stretch holds the sources at about their weights.

Blocks are ranges of a hash of doc_id, at most ``MAX_BLOCKS`` a source, so that neither a large source nor
a window over its blocks is one task's load. One total for each source comes to the driver, if there are no
more than ``MAX_SOURCES``; beyond, the exponent is searched by passes over the table of totals.

Defined cases: a null source is a source of its own, unlike any name; rows with a null doc_id stand at one place of
their source; a null or empty text has no tokens and is read once a
pass; a source without tokens is read once; repeated rows are each read; only ``doc_id``, ``text`` and
``source`` are read (``realise`` keeps all columns of its input, unless they are named like its own, which
then replace them); an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil, exp, floor, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annoloom.llm.common import materialise, skew_safe_lookup

BLOCK_TOKENS, MAX_BLOCKS, MAX_SOURCES = 16_384, 4096, 100_000
#: A plan of up to so many blocks is broadcast.
BROADCAST_BLOCKS = 500_000


def weights_of(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Shares to the power ``exponent``, normalised; sources without tokens weigh nothing."""
    total = sum(tokens.values())
    raw = {s: exp(exponent * log(n / total)) if n else 0.0 for s, n in tokens.items()}
    norm = sum(raw.values()) or 1.0
    return {s: w / norm for s, w in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * log(w) for w in weights.values() if w > 0)


def total_budget(tokens: dict[str, int], weights: dict[str, float]) -> float:
    """The least number of tokens at which every source is read whole."""
    return max((tokens[s] / w for s, w in weights.items() if w > 0), default=0.0)


def repetition(tokens: dict[str, int], weights: dict[str, float]) -> float:
    """Passes over the source that is read most often."""
    total = total_budget(tokens, weights)
    return max((total * w / tokens[s] for s, w in weights.items() if w > 0), default=0.0)


def find_exponent(tokens: dict[str, int], max_repeats: float | None = None, target_entropy: float | None = None, rounds: int = 60) -> float:
    """The smallest exponent in [0, 1] with at most ``max_repeats`` passes over any source, or the one whose
    weights have ``target_entropy`` (both fall steadily as the exponent rises)."""
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give either max_repeats or target_entropy")

    def too_flat(a: float) -> bool:
        w = weights_of(tokens, a)
        return repetition(tokens, w) > max_repeats if max_repeats is not None else entropy(w) > target_entropy

    low, high = 0.0, 1.0
    if not too_flat(low):
        return low
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if too_flat(middle) else (low, middle)
    return high


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _source() -> Column:
    """The key of a source; null is unlike any name."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit("block")), blocks)


def _place(epoch: Column) -> Column:
    """A document's place in its block in a pass, from 0 up to 2**40."""
    return F.pmod(F.xxhash64(F.col("doc_id"), epoch.cast("int"), F.lit("place")), F.lit(1 << 40))


def _figures(sums: DataFrame, exponents: list[float]) -> list[tuple[float, float, float, float]]:
    """For each exponent: the norm of the weights, their entropy, the least budget and its highest repetition; one
    pass over the sources' totals."""
    total = float(sums.agg(F.sum("n_tokens")).first()[0] or 0)
    n = F.col("n_tokens").cast("double")
    raw = [F.exp(F.lit(float(a)) * F.log(n / total)) for a in exponents]
    asked = [c for x in raw for c in (F.sum(x), F.sum(x * F.log(x)), F.max(n / x), F.max(x / n))]
    got = sums.filter("n_tokens > 0").agg(*asked).first()
    out = []
    for i in range(0, len(asked), 4):
        norm, spread, widest, most = got[i : i + 4]
        out.append((norm, log(norm) - spread / norm, norm * widest, widest * most))
    return out


def search_exponent(sums: DataFrame, max_repeats: float | None = None, target_entropy: float | None = None, ways: int = 32, rounds: int = 12) -> float:
    """``find_exponent`` over totals that stay in a table: each pass tries ``ways`` - 1 exponents and keeps the
    interval that holds the answer, so twelve passes reach the last digit."""
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give either max_repeats or target_entropy")
    too_flat = (lambda f: f[3] > max_repeats) if max_repeats is not None else (lambda f: f[1] > target_entropy)
    low, high = 0.0, 1.0
    if not too_flat(_figures(sums, [low])[0]):
        return low
    for _ in range(rounds):
        tried = [low + (high - low) * k / ways for k in range(1, ways)]
        flat = sum(map(too_flat, _figures(sums, tried)))
        low, high = ([low, *tried][flat], [*tried, high][flat])
    return high


def plan_mixture(docs: DataFrame, max_repeats: float | None = 1.5, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """One row for each block and pass: _source, n_blocks, n_rows, block, epoch, slot_from, slot_width, upto (the
    last place that is read of a block that is cut). ``budget``: tokens of the mixture; by default the least at which
    every source is read whole. With a smaller one sources are read in part."""
    counted = docs.select("doc_id", _source().alias("_source"), token_count(F.col("text")).alias("n_tokens"))
    rows = materialise(counted, "tokens")
    sums = materialise(rows.groupBy("_source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows")), "sources")
    n_sources, n_rows, exponent, norm, total = sums.count(), rows.count(), 0.0, 1.0, 0.0
    if not sums.filter("n_tokens > 0").isEmpty():
        if n_sources <= MAX_SOURCES:
            tokens = {r["_source"]: r["n_tokens"] for r in sums.collect()}
            exponent = find_exponent(tokens, max_repeats, target_entropy)
        else:
            exponent = search_exponent(sums, max_repeats, target_entropy)
        norm, _, total, _ = _figures(sums, [exponent])[0]
    n = F.col("n_tokens")
    grand = sums.agg(F.sum("n_tokens")).first()[0] or 0
    weight = F.when(n > 0, F.exp(F.lit(exponent) * F.log(n / float(max(grand, 1)))) / norm).otherwise(0.0)
    own = F.greatest(n.cast("double"), F.bround(total * weight)) if budget is None else F.bround(float(budget) * weight)
    passes = F.when(n > 0, F.floor(F.col("budget") / n)).otherwise(1).cast("int")
    facts = sums.withColumn("budget", own).withColumn("passes", passes).withColumn("rest", F.when(n > 0, F.col("budget") - F.col("passes") * n).otherwise(0.0))
    facts = facts.withColumn("n_blocks", F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(n / BLOCK_TOKENS))).cast("long")).withColumnRenamed("n_tokens", "total")
    facts = materialise(facts, "facts")
    blocks = _per_source(rows, facts, n_sources, n_rows).withColumn("block", _block(F.col("n_blocks")))
    sized = blocks.groupBy("_source", "block").agg(F.sum("n_tokens").alias("size"), *[F.first(c).alias(c) for c in ("n_blocks", "n_rows", "total", "budget", "passes", "rest")])
    sized = materialise(sized, "blocks")
    last = F.col("passes") - F.when(F.col("rest") >= 1, 0).otherwise(1)
    each = sized.filter(last >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    order = Window.partitionBy("_source", "epoch").orderBy(F.xxhash64("_source", "block", "epoch"), "block")
    each = each.withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["before"])
    last = F.col("epoch") == F.col("passes")
    each = each.filter(~last | (F.col("before") < F.col("rest"))).withColumn("room", F.when(last, F.col("rest") - F.col("before")))
    cut = each.filter(F.col("room") < F.col("size")).select("_source", "block", "epoch", "room")
    inside = blocks.select("_source", "block", "doc_id", "n_tokens").join(cut, ["_source", "block"]).withColumn("place", _place(F.col("epoch")))
    by_place = Window.partitionBy("_source", "block").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("done", F.coalesce(F.sum("n_tokens").over(by_place), F.lit(0)))
    upto = inside.filter(F.col("done") < F.col("room")).groupBy("_source", "block", "epoch").agg(F.max("place").alias("upto"))
    plan = each.join(upto, ["_source", "block", "epoch"], "left")
    scale = F.greatest("budget", F.lit(1.0))
    return plan.select(
        "_source", "n_blocks", "n_rows", "block", "epoch", "upto",
        ((F.col("epoch") * F.col("total") + F.col("before")) / scale).alias("slot_from"),
        (F.least(F.col("size").cast("double"), F.coalesce("room", F.col("size").cast("double"))) / scale).alias("slot_width"),
    )


def _per_source(rows: DataFrame, sources: DataFrame, n_sources: int, n_rows: int) -> DataFrame:
    """Inner join with a table of one row a source: broadcast, or with very many sources heavy ones apart."""
    if n_sources <= MAX_SOURCES:
        return rows.join(F.broadcast(sources), "_source")
    return skew_safe_lookup(rows, sources, ["_source"], "n_rows", n_rows).filter("n_blocks IS NOT NULL")


def realise(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of ``docs`` as the plan reads them, with epoch, block and slot."""
    plan = materialise(plan, "mixture")
    sources = materialise(plan.groupBy("_source").agg(F.first("n_blocks").alias("n_blocks"), F.first("n_rows").alias("n_rows")), "mixed")
    few = plan.count() <= BROADCAST_BLOCKS
    n_sources, n_rows = sources.count(), sources.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    names = [c for c in docs.columns if c not in ("epoch", "block", "slot")]
    rows = _per_source(docs.select(*names).withColumn("_source", _source()), sources, n_sources, n_rows)
    rows = rows.withColumn("block", _block(F.col("n_blocks"))).drop("n_blocks", "n_rows")
    plan = plan.drop("n_blocks", "n_rows")
    rows = rows.join(F.broadcast(plan) if few else plan, ["_source", "block"]).withColumn("_place", _place(F.col("epoch")))
    rows = rows.filter(F.col("upto").isNull() | (F.col("_place") <= F.col("upto")))
    slot = F.col("slot_from") + F.col("slot_width") * (F.col("_place") / float(1 << 40))
    return rows.select(*names, "epoch", "block", slot.alias("slot"))


def mix(docs: DataFrame, max_repeats: float | None = 1.5, target_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    return realise(docs, plan_mixture(docs, max_repeats, target_entropy, budget))


def report(docs: DataFrame, max_repeats: float = 1.5) -> DataFrame:
    """(doc_id, source, epoch, block, slot) of every reading of a document."""
    plan = plan_mixture(docs, max_repeats)
    return realise(docs.select("doc_id", "source"), plan)
