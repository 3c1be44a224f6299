"""Building name indexes, label and formula tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoloom.functions.text import clean, split_synonyms


def name_index(names: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, name, db_ids): inverted index of (name, db_id, ord): lower-cased names to their distinct ids in
    order of first occurrence. ``by`` (an organism, say) scopes the index; one job builds all of them."""
    firsts = names.filter(F.trim("name") != "").groupBy(*by, F.lower("name").alias("name"), "db_id").agg(F.min("ord").alias("ord"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "db_id")))
    return firsts.groupBy(*by, "name").agg(F.transform(ordered, lambda x: x["db_id"]).alias("db_ids"))


def exploded_index(names: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The index as rows: (by, name, db_id, id_pos)."""
    return name_index(names, by).select(*by, "name", F.posexplode("db_ids").alias("id_pos", "db_id"))


def last_label(rows: DataFrame) -> DataFrame:
    """(db_id, label) of (db_id, label, ord): of repeated ids the last row wins."""
    return rows.groupBy("db_id").agg(F.max_by("label", "ord").alias("label"))


def upsert_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old labels with the new ones put over them; an empty new label is ``gene_<id>``."""
    fresh = new.select("db_id", F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("gene_"), F.col("db_id").cast("string"))).alias("fresh"))
    return old.join(fresh, "db_id", "full").select("db_id", F.coalesce("fresh", "label").alias("label"))


def secondary_to_primary(classes: DataFrame) -> DataFrame:
    """(any_id, primary_id): each id to itself, each alternative id to its class."""
    own = classes.select(F.col("id").alias("any_id"), F.col("id").alias("primary_id"))
    return own.unionByName(classes.select(F.explode("alternative_id").alias("any_id"), F.col("id").alias("primary_id")))


def collected_synonyms(classes: DataFrame) -> DataFrame:
    """(id, names): distinct lower-cased label, exact and related synonyms, sorted."""
    empty = F.array().cast("array<string>")
    every = F.concat(F.array("label"), F.coalesce("exact_synonym", empty), F.coalesce("related_synonym", empty))
    return classes.select("id", F.array_sort(F.array_distinct(F.transform(F.filter(every, lambda x: x.isNotNull()), F.lower))).alias("names"))


def clean_gene_info(genes: DataFrame, types: tuple[str, ...] | None = None, tax_ids: tuple[str, ...] | None = None) -> DataFrame:
    """(tax_id, db_id, symbol, names): symbols and synonyms without sentinels, symbol first."""
    if types is not None:
        genes = genes.filter(F.col("type_of_gene").isin(*types))
    if tax_ids is not None:
        genes = genes.filter(F.col("tax_id").cast("string").isin(*tax_ids))
    rows = genes.withColumn("symbol", clean(F.col("Symbol")))
    names = F.concat(F.when(F.col("symbol").isNotNull(), F.array("symbol")).otherwise(F.array().cast("array<string>")), split_synonyms(clean(F.col("Synonyms")), F.col("symbol")))
    return rows.select(F.col("tax_id").cast("string").alias("tax_id"), F.col("GeneID").cast("string").alias("db_id"), "symbol", names.alias("names"))


def counts_by_type(rows: DataFrame, group: str, kind: str, kinds: list[str]) -> DataFrame:
    """A count a kind for each group, 0 where there is none, and their total. With the kinds given, the
    pivot needs no extra pass."""
    wide = rows.groupBy(group).pivot(kind, kinds).count().na.fill(0, kinds)
    total = sum((F.col(f"`{k}`") for k in kinds[1:]), F.col(f"`{kinds[0]}`"))
    return wide.withColumn("total", total)


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))
