"""Matching synonyms with name indexes: exact, partial, scored, ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annoloom.functions.text import normalise_name
from annoloom.options import LinkOptions

#: Characters of a gram, and strings that may share one before it is dealt over several places.
GRAM, HEAVY_GRAM = 3, 100_000


def is_unknown(synonyms: Column) -> Column:
    """Whether the synonyms are just ``UNK``."""
    return (F.size(synonyms) == 1) & (F.element_at(synonyms, 1) == "UNK")


def with_default_synonym(entities: DataFrame, synonyms: DataFrame, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """Entities with their synonyms; one without any gets its own id."""
    joined = entities.join(synonyms.select(*keys, "synonyms"), list(keys), "left")
    return joined.withColumn("synonyms", F.coalesce("synonyms", F.array("entity_id")))


def probe_keys(mentions: DataFrame) -> DataFrame:
    """(entity_id, key, n, times, syn_pos) of mentions (entity_id, synonyms): their distinct keys."""
    probes = mentions.filter(~is_unknown(F.col("synonyms")) & (F.size("synonyms") > 0))
    probes = probes.select("entity_id", F.size("synonyms").alias("n"), F.posexplode("synonyms").alias("syn_pos", "synonym"))
    probes = probes.withColumn("key", normalise_name(F.col("synonym"))).filter("key <> ''")
    return probes.groupBy("entity_id", "key").agg(F.first("n").alias("n"), F.count("*").alias("times"), F.min("syn_pos").alias("syn_pos"))


def known_keys(index: DataFrame, options: LinkOptions) -> DataFrame:
    """(key, db_id, names, place) of an index (name, db_id, id_pos, name_ord)."""
    key = F.lower("name") if options.compat else normalise_name(F.col("name"))
    known = index.withColumn("key", key).filter("key <> ''")
    return known.groupBy("key", "db_id").agg(F.count("*").alias("names"), F.min(F.struct("name_ord", "id_pos")).alias("place"))


def direct_match(mentions: DataFrame, index: DataFrame, options: LinkOptions | None = None) -> DataFrame:
    """(entity_id, db_id, score, cand_pos). ``mentions`` has (entity_id, synonyms), ``index`` (name, db_id,
    id_pos, name_ord). The score is hits over synonyms; candidates stand in order of first hit. Both sides are
    folded by key before they meet, so a pair comes out of the join once however often its names repeat; hot
    names are left to the split of skewed joins, for all their pairs are results."""
    hits = probe_keys(mentions).join(known_keys(index, options or LinkOptions()), "key")
    first = F.struct("syn_pos", "place.name_ord", "place.id_pos")
    scored = hits.groupBy("entity_id", "db_id").agg((F.sum(F.col("times") * F.col("names")) / F.first("n")).alias("score"), F.min(first).alias("first"))
    order = Window.partitionBy("entity_id").orderBy("first", "db_id")
    return scored.withColumn("cand_pos", F.row_number().over(order) - 1).drop("first")


def _confidence(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.least(F.length(a), F.length(b)) / longest)


def _substrings(text: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters."""
    found = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def partial_pairs(queries: DataFrame, names: DataFrame, query: str = "q", name: str = "ref") -> DataFrame:
    """All pairs in which one string holds the other, neither being empty. Grams of the longer strings are
    counted; a shorter string looks for the longer ones under the rarest of its own grams (or under its whole
    text, if that is shorter than a gram), and not at all if one of them never occurs. Grams of more than
    ``HEAVY_GRAM`` strings are dealt over several places. Each pair comes out once."""
    q = queries.select(F.col(query).alias("q")).distinct().filter("q <> ''")
    r = names.select(F.col(name).alias("r")).distinct().filter("r <> ''")

    def inside(short: DataFrame, s: str, long: DataFrame, t: str) -> DataFrame:
        grams = [_substrings(F.col(t), n) for n in range(1, GRAM + 1)]
        pieces = long.select(t, F.explode(F.flatten(F.array(*grams))).alias("k"))
        counted = pieces.groupBy("k").agg(F.count("*").alias("n"))
        own = F.when(F.length(s) >= GRAM, _substrings(F.col(s), GRAM)).otherwise(F.array(s))
        sought = short.select(s, F.size(own).alias("own"), F.explode(own).alias("k")).join(counted, "k")
        sought = sought.groupBy(s).agg(F.min(F.struct("n", "k")).alias("rarest"), F.count("*").alias("met"), F.first("own").alias("own")).filter("met = own")
        places = F.ceil(F.col("n") / HEAVY_GRAM).cast("int")
        heavy = counted.filter(F.col("n") > HEAVY_GRAM).select("k", places.alias("places"))
        keyed = sought.select(s, "rarest.k", "rarest.n").withColumn("place", F.explode(F.sequence(F.lit(0), places - 1))).drop("n")
        dealt = pieces.join(heavy, "k", "left").withColumn("place", F.pmod(F.xxhash64(t), F.coalesce("places", F.lit(1))).cast("int")).drop("places")
        return keyed.join(dealt, ["k", "place"]).filter(F.contains(t, s)).select("q", "r")

    return inside(q, "q", r, "r").unionByName(inside(r, "r", q, "q").filter("q <> r"))


def ranked_search(queries: DataFrame, index: DataFrame, options: LinkOptions | None = None) -> DataFrame:
    """(query, db_id, name, confidence, rank): exact matches with confidence 1, else partial ones by the ratio of
    lengths; the first ``max_candidates``. Empty queries find nothing."""
    options = options or LinkOptions()
    q = queries.select("query", normalise_name(F.col("query")).alias("q")).filter("q <> ''").distinct()
    r = index.withColumn("r", normalise_name(F.col("name")))
    exact = q.join(r, q["q"] == r["r"]).withColumn("confidence", F.lit(1.0))
    rest = q.join(exact.select("query").distinct(), "query", "left_anti")
    pairs = partial_pairs(rest, r, "q", "r")
    partial = rest.join(pairs, "q").join(r, "r").withColumn("confidence", _confidence(F.col("q"), F.col("r")))
    columns = ["query", "db_id", "name", "confidence", "name_ord", "id_pos"]
    found = exact.select(*columns).unionByName(partial.select(*columns))
    order = Window.partitionBy("query").orderBy(F.desc("confidence"), "name_ord", "id_pos", "db_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= options.max_candidates).drop("name_ord", "id_pos")


def with_labels(rows: DataFrame, labels: DataFrame, column: str = "db_id") -> DataFrame:
    """Adds ``label``: the id's label, or the id."""
    looked = labels.select(F.col("db_id").alias(column), F.col("label").alias("_label"))
    return rows.join(looked, column, "left").withColumn("label", F.coalesce("_label", F.col(column).cast("string"))).drop("_label")


def term_scan(texts: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """Adds ``term``: one row for each term that the lower-cased text holds. The terms are in the plan."""
    low = F.lower(F.col(text))
    held = F.filter(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms]), lambda x: x.isNotNull())
    return texts.withColumn("term", F.explode(held))
