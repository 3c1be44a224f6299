"""Reference tables in a folder: where they are, opening them, building vector collections, linking with them.

Layout under a base folder: ``<database>/names`` (for genes in folders by ``tax_id``), ``<database>/labels``,
``<database>/formulas``, ``<database>/vectors/<collection>``, all Parquet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoloom.functions.vector import similarity
from annoloom.operators import catalogue, context, index, providers, vector
from annoloom.operators.providers import Embedder, SynonymProvider
from annoloom.options import DATABASES
from annoloom.sources import readers, writers
from annoloom.workflows import Reference

#: The session setting that names the base folder where none is given.
SETTING = "spark.annoloom.data"


def base_folder(spark: SparkSession, base: str | None = None) -> str:
    """The folder of reference tables: the one given, else the session's setting."""
    base = base or spark.conf.get(SETTING, None)
    if not base:
        raise ValueError(f"give the folder of reference tables, or set {SETTING}")
    return base.rstrip("/")


def table_path(base: str, database: str, table: str, collection: str | None = None) -> str:
    if database not in DATABASES:
        raise ValueError(f"database {database!r} is not one of {sorted(DATABASES)}")
    return "/".join([base.rstrip("/"), database, table, *([collection] if collection else [])])


def databases(spark: SparkSession, base: str | None = None) -> dict[str, bool]:
    """Which databases have names and labels."""
    base = base_folder(spark, base)
    there = lambda d, t: catalogue.readable(spark, table_path(base, d, t))
    return {d: there(d, "names") and there(d, "labels") for d in DATABASES}


def open_reference(spark: SparkSession, database: str, base: str | None = None, collection: str = "default", embedder: Embedder | str = "default") -> Reference:
    """The tables of a database. Names and labels must be there; formulas and vectors may be."""
    base = base_folder(spark, base)
    paths = {t: table_path(base, database, t) for t in ("names", "labels", "formulas")} | {"vectors": table_path(base, database, "vectors", collection)}
    found = {t: catalogue.readable(spark, p) for t, p in paths.items()}
    for t in ("names", "labels"):
        if not found[t]:
            raise FileNotFoundError(f"no {t} of {database} at {paths[t]}")
    return Reference(
        readers.read_name_index(spark, paths["names"]),
        readers.read_labels(spark, paths["labels"]),
        readers.read_formulas(spark, paths["formulas"]) if found["formulas"] else None,
        spark.read.parquet(paths["vectors"]) if found["vectors"] else None,
        providers.embedder_for(embedder) if isinstance(embedder, str) else embedder,
    )


def write_reference(names: DataFrame, labels: DataFrame, base: str, database: str, formulas: DataFrame | None = None) -> None:
    """Tables from (name, db_id, ord), for genes with tax_id, and (db_id, label, ord) and (db_id, formula)."""
    by = ("tax_id",) if "tax_id" in names.columns else ()
    order = names.groupBy(*by, F.lower("name").alias("name"), "db_id").agg(F.min("ord").cast("long").alias("name_ord"))
    rows = index.exploded_index(names, by).join(order, [*by, "name", "db_id"])
    if by:
        writers.write_name_index(rows, table_path(base, database, "names"))
    else:
        rows.write.mode("overwrite").parquet(table_path(base, database, "names"))
    writers.write_labels(index.last_label(labels), table_path(base, database, "labels"))
    if formulas is not None:
        writers.write_formulas(formulas, table_path(base, database, "formulas"))


@dataclass(frozen=True)
class IndexOptions:
    """collection: name of the vectors' folder. embedder: its name. batch_rows: rows of a call to it. sample: only as
    many names, by their order, to try an index out; 0 for all."""

    collection: str = "default"
    embedder: str = "default"
    batch_rows: int = 500
    sample: int = 0

    def __post_init__(self) -> None:
        if self.batch_rows < 1 or self.sample < 0:
            raise ValueError("batch_rows must be positive and sample not negative")


def build_vectors(names: DataFrame, base: str, database: str, options: IndexOptions | None = None, embedder: Embedder | None = None) -> str:
    """Embed names (name, db_id, ord), one document a name of an id, numbered within it, and write the collection;
    returns its path."""
    options = options or IndexOptions()
    embedder = embedder or providers.embedder_for(options.embedder)
    size = options.batch_rows

    def in_batches(texts: list[str]) -> list[list[float]]:
        return [v for at in range(0, len(texts), size) for v in embedder(texts[at : at + size])]

    if options.sample:
        names = names.orderBy("ord", "db_id", "name").limit(options.sample)
    listed = names.filter(F.trim("name") != "").groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("x"))
    rows = listed.select("db_id", F.posexplode("x").alias("pos", "e")).select(F.concat("db_id", F.lit("_"), F.col("pos").cast("string")).alias("doc_id"), "db_id", "e.name")
    path = table_path(base, database, "vectors", options.collection)
    writers.write_vectors(rows, in_batches, path)
    return path


class EntityLinker:
    """Links mentions to the ids of a vector collection."""

    def __init__(self, reference: Reference, top_k: int = 5, metric: str = "l2sq"):
        if reference.vectors is None or reference.embedder is None:
            raise ValueError("the reference has no vectors; build them first")
        self.reference, self.top_k, self.metric = reference, top_k, metric

    def retrieve(self, mentions: DataFrame) -> DataFrame:
        """(query, doc_id, db_id, name, distance, score, rank) of each of ``mentions`` (query)."""
        asked = mentions.select("query").filter("query IS NOT NULL").distinct()
        queries = providers.embed(asked.select(F.col("query").alias("doc_id"), F.lit(None).cast("string").alias("db_id"), F.col("query").alias("name")), self.reference.embedder)
        found = vector.nearest(queries.select(F.col("doc_id").alias("query_id"), "embedding"), self.reference.vectors, self.top_k, self.metric)
        named = found.join(self.reference.vectors.select("doc_id", "db_id", "name"), "doc_id")
        return named.select(F.col("query_id").alias("query"), "doc_id", "db_id", "name", "distance", similarity(F.col("distance")).alias("score"), "rank")

    def link(self, mentions: DataFrame) -> DataFrame:
        """(query, db_id, name, confidence): the best candidate of each mention; without any, null and 0."""
        best = self.retrieve(mentions).filter("rank = 1").select("query", "db_id", "name", F.col("score").alias("confidence"))
        return mentions.select("query").distinct().join(best, "query", "left").na.fill(0.0, ["confidence"])

    def prompts(self, mentions: DataFrame) -> DataFrame:
        """(query, candidates, system_prompt, prompt): what a model is asked to decide."""
        candidate = F.struct("rank", F.col("name").alias("label"), "db_id", "score")
        listed = self.retrieve(mentions).groupBy("query").agg(F.array_sort(F.collect_list(candidate)).alias("candidates"))
        return listed.select("query", "candidates", F.lit("Decide which candidate a mention means.").alias("system_prompt"), context.linking_prompt(F.col("query"), F.col("candidates")).alias("prompt"))

    def decide(self, mentions: DataFrame, provider: SynonymProvider) -> DataFrame:
        """(query, db_id, name, confidence): the candidate whose number the provider answers; null for NONE, for an
        answer without a number and for one that is no candidate's."""
        asked = self.prompts(mentions)
        said = providers.ask(asked, provider, key="query").select("query", F.expr("try_cast(regexp_extract(raw_response, '([0-9]+)', 1) AS int)").alias("n"))
        chosen = asked.join(said, "query").select("query", F.expr("try_element_at(candidates, CASE WHEN n > 0 THEN n END)").alias("c"))
        best = chosen.select("query", "c.db_id", F.col("c.label").alias("name"), F.col("c.score").alias("confidence"))
        return mentions.select("query").distinct().join(best, "query", "left").na.fill(0.0, ["confidence"])


def smoke_search(linker: EntityLinker, queries: list[str], k: int = 5) -> DataFrame:
    """The nearest candidates of a few test queries."""
    spark = linker.reference.vectors.sparkSession
    return linker.retrieve(spark.createDataFrame([(q,) for q in queries], "query string")).filter(F.col("rank") <= k).orderBy("query", "rank")
