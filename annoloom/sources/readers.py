"""Sources: model documents (XML), ontology classes, gene tables, dictionaries, saved answers, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annoloom import schemas
from annoloom.functions.text import CHEBI_URI_PATTERNS, NCBIGENE_URI_PATTERNS, display_name, extract_all, stem, strip_prefix
from annoloom.operators.context import format_of


def read_documents(spark: SparkSession, path: str, start_at: int = 1, num_models: int | None = None, pattern: str = "*") -> DataFrame:
    """(file, content) of whole files in order of their paths, from the ``start_at``-th (1-based) on. The two
    paths that bound the slice come from a listing without contents; files outside it are not opened. A file
    without a byte has no row."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=pattern)
    at = F.col("_metadata.file_path")
    if start_at > 1 or num_models is not None:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(at.alias("file")).orderBy("file")
        bounds = [listed.offset(n).limit(1).collect() for n in (start_at - 1, *([] if num_models is None else [start_at - 1 + num_models]))]
        rows = rows.filter(at >= bounds[0][0]["file"]) if bounds[0] else rows.filter(F.lit(False))
        if len(bounds) > 1 and bounds[1]:
            rows = rows.filter(at < bounds[1][0]["file"])
    return rows.select(at.alias("file"), F.col("value").alias("content"))


_NOTED = "annotation: string"
_SPECIES = f"array<struct<_id: string, _name: string, {_NOTED}>>"
_PRODUCTS = f"array<struct<_id: string, _name: string, _label: string, {_NOTED}>>"
_SIDE = "struct<speciesReference: array<struct<_species: string, _stoichiometry: string>>>"
_REACTIONS = f"array<struct<_id: string, _reversible: string, listOfReactants: {_SIDE}, listOfProducts: {_SIDE}>>"
MODEL_XML = (
    f"model struct<_id: string, _name: string, notes: string, species: {_SPECIES}, listOfSpecies: struct<species: {_SPECIES}>, "
    f"listOfGeneProducts: struct<geneProduct: {_PRODUCTS}>, listOfQualitativeSpecies: struct<qualitativeSpecies: {_SPECIES}>, "
    f"listOfReactions: struct<reaction: {_REACTIONS}>, listOfTransitions: struct<transition: array<struct<_id: string>>>>, _corrupt string"
)


def parse_models(documents: DataFrame) -> DataFrame:
    """(file, parse_status, format, model, notes, species, products, qualitative, reactions, num_species,
    num_reactions, num_gene_products, num_qualitative_species, num_transitions), one row a document of (file,
    content). ``model`` is its name, else its id; entities are arrays of (entity_id, name, label, annotation);
    notes and annotations keep their markup. A document that is no XML, or cut off, is ``malformed``; one without
    a model is ``no model``; both have empty arrays, counts of 0 and format ``plain``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreNamespace": "true"}
    rows = documents.select("file", F.from_xml(F.coalesce("content", F.lit("")), MODEL_XML, options).alias("x"))
    m = F.col("x.model")
    status = F.when(F.col("x._corrupt").isNotNull(), "malformed").when(m.isNull(), "no model").otherwise("ok")
    none = lambda xs: F.coalesce(xs, F.array())

    def named(xs: Column, label: bool = False) -> Column:
        return F.transform(
            none(xs), lambda e: F.struct(e["_id"].alias("entity_id"), e["_name"].alias("name"), (e["_label"] if label else F.lit(None).cast("string")).alias("label"), e["annotation"].alias("annotation"))
        )

    rows = rows.select(
        "file", status.alias("parse_status"), F.coalesce(m["_name"], m["_id"], F.lit("")).alias("model"), m["notes"].alias("notes"),
        F.concat(named(m["species"]), named(m["listOfSpecies"]["species"])).alias("species"),
        named(m["listOfGeneProducts"]["geneProduct"], True).alias("products"), named(m["listOfQualitativeSpecies"]["qualitativeSpecies"]).alias("qualitative"),
        none(m["listOfReactions"]["reaction"]).alias("reactions"), F.size(none(m["listOfTransitions"]["transition"])).alias("num_transitions"),
    )
    sizes = {"num_species": "species", "num_reactions": "reactions", "num_gene_products": "products", "num_qualitative_species": "qualitative"}
    rows = rows.withColumns({n: F.size(c) for n, c in sizes.items()})
    return rows.withColumn("format", format_of(F.col("num_gene_products"), F.col("num_qualitative_species")))


def model_reactions(reactions: Column) -> Column:
    """``id: 2 a + b => c`` of the irreversible reactions; a reaction without the attribute is reversible."""

    def side(xs: Column) -> Column:
        count = lambda s: F.regexp_replace(F.coalesce(s["_stoichiometry"], F.lit("1")), r"\.0+$", "")
        return F.array_join(F.transform(F.coalesce(xs, F.array()), lambda s: F.when(count(s) == "1", s["_species"]).otherwise(F.concat(count(s), F.lit(" "), s["_species"]))), " + ")

    one_way = F.filter(reactions, lambda r: F.lower(r["_reversible"]).isin("false", "0"))
    return F.transform(one_way, lambda r: F.concat(r["_id"], F.lit(": "), side(r["listOfReactants"]["speciesReference"]), F.lit(" => "), side(r["listOfProducts"]["speciesReference"])))


def entity_array(entity_type: str) -> Column:
    """The entities of a parsed model that are of the type; null for gene entities of a ``plain`` model."""
    if entity_type == "chemical":
        return F.col("species")
    return F.when(F.col("format") == "fbc", F.col("products")).when(F.col("format") == "qual", F.col("qualitative"))


def annotated_ids(annotation: Column, entity_type: Column) -> Column:
    """The ids in an annotation: chemical or gene ids by the entity's type."""
    text = F.coalesce(annotation, F.lit(""))
    return F.when(entity_type == "gene", extract_all(text, NCBIGENE_URI_PATTERNS)).otherwise(extract_all(text, CHEBI_URI_PATTERNS))


def entities(models: DataFrame, entity_type: str | None = None) -> DataFrame:
    """(file, format, entity_type, entity_id, name, label, display_name, ord, annotation) of parsed models, in
    document order. ``chemical`` entities are the species of every model; ``gene`` entities are the products of
    ``fbc`` and the qualitative species of ``qual`` models. The display name of a species is its name, empty if
    it has none; of a product its name, label or id; of a qualitative species its name or id."""
    parts = []
    for kind in ("chemical", "gene"):
        if entity_type in (None, kind):
            # the outer form, whose empty rows go afterwards: of the inner one Spark makes a filter that parses once more
            each = models.select("file", "format", F.lit(kind).alias("entity_type"), F.posexplode_outer(entity_array(kind)).alias("ord", "e"))
            parts.append(each.filter("ord IS NOT NULL"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    shown = F.when(F.col("entity_type") == "chemical", F.coalesce("e.name", F.lit(""))).otherwise(display_name(F.col("e.name"), F.col("e.label"), F.col("e.entity_id")))
    return rows.select("file", "format", "entity_type", "e.entity_id", "e.name", "e.label", shown.alias("display_name"), "ord", "e.annotation")


def existing_annotations(entities: DataFrame) -> DataFrame:
    """(file, entity_id, ord, db_id): ids in the entities' annotations, chemical or gene ids by their type."""
    each = entities.select("file", "entity_id", "ord", F.explode_outer(annotated_ids(F.col("annotation"), F.col("entity_type"))).alias("db_id"))
    return each.filter("db_id IS NOT NULL")


def read_ontology(spark: SparkSession, path: str, row_tag: str = "owl:Class") -> DataFrame:
    """Ontology classes with an id; the prefix of ids is dropped, fields with several values are arrays."""
    schema = (
        "`oboInOwl:id` string, `rdfs:label` string, `oboInOwl:hasExactSynonym` array<string>, `oboInOwl:hasRelatedSynonym` array<string>, "
        "`chebi:formula` array<string>, `oboInOwl:hasAlternativeId` array<string>"
    )
    rows = spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").schema(schema).load(path)
    names = [n.strip().split(" ")[0] for n in schemas.ONTOLOGY_CLASS.split(", ")]
    rows = rows.toDF(*names).filter(F.col("id").isNotNull())
    return rows.withColumn("id", strip_prefix(F.col("id"))).withColumn("alternative_id", F.transform("alternative_id", lambda x: strip_prefix(x)))


def read_gene_info(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Gene table (tab-separated, with a header; gzip cannot be split, so rows are dealt anew on request)."""
    rows = spark.read.csv(path, sep="\t", header=True)
    rows = rows.select(F.col("#tax_id").alias("tax_id"), "GeneID", "Symbol", "Synonyms", "type_of_gene")
    return rows.repartition(partitions) if partitions else rows


def read_name_index(spark: SparkSession, path: str, tax_id: str | None = None) -> DataFrame:
    """A name index; ``tax_id`` prunes its partitions."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col("tax_id") == tax_id) if tax_id is not None else rows


def read_id_names(spark: SparkSession, path: str, tax_id: str | None = None) -> DataFrame:
    """(db_id, names): all names of each id, in index order, from a name index."""
    rows = read_name_index(spark, path, tax_id)
    named = rows.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("name_ord", "id_pos", "name"))).alias("x"))
    return named.select("db_id", F.array_distinct(F.transform("x", lambda x: x["name"])).alias("names"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LABELS).parquet(path)


def read_formulas(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FORMULAS).parquet(path)


def read_results(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).option("header", True).format(fmt).load(path)


def read_saved_responses(spark: SparkSession, path: str) -> DataFrame:
    """(model, content) of saved answers; the model is the file's stem with ``.xml``."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.concat(stem(F.input_file_name()), F.lit(".xml")).alias("model"), F.col("value").alias("content"))
