"""Whole workflows over many models at once: annotate, curate, evaluate, replay.

Each takes model documents (file, content), from ``sources.readers.read_documents`` or any table, a provider of
answers, reference tables by database, and options; it returns tables. Answers are asked for once: they are written
to a folder that driver and executors share before anything reads them. Nothing of the models comes to the driver.

A model that is malformed, has no entities of the type, or whose answer names none has no rows in the tables; its row
of figures says why in ``status``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annoloom.functions.response import parse_responses, saved_body
from annoloom.functions.text import basename, drop_boilerplate, identifiers, names_or_na, strip_tags
from annoloom.operators import context, evaluate, match, providers, vector, workflow
from annoloom.operators.providers import Embedder, SynonymProvider
from annoloom.options import LinkOptions
from annoloom.sources import readers


@dataclass(frozen=True)
class Reference:
    """Tables of a database: names (name, db_id, id_pos, name_ord, for genes also tax_id), labels (db_id, label),
    formulas (db_id, formula), vectors (doc_id, db_id, embedding) and what embedded them."""

    names: DataFrame
    labels: DataFrame
    formulas: DataFrame | None = None
    vectors: DataFrame | None = None
    embedder: Embedder | None = None


@dataclass(frozen=True)
class Linked:
    """The result of a workflow: its table, a row of figures for each model, the parsed answers."""

    table: DataFrame
    metrics: DataFrame
    answers: DataFrame


def _kept(df: DataFrame, work: str | None, name: str) -> DataFrame:
    """Written and read back, so that it is computed once and survives lost executors."""
    spark = df.sparkSession
    work = work or spark.conf.get("spark.checkpoint.dir", None)
    if not work:
        raise ValueError("give a shared folder for intermediate tables, or set spark.checkpoint.dir")
    path = f"{work.rstrip('/')}/annoloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reference_for(references: dict[str, Reference], options: LinkOptions) -> Reference:
    if options.database not in references:
        raise ValueError(f"no reference tables for database {options.database!r}")
    return references[options.database]


def index_for(reference: Reference, options: LinkOptions) -> DataFrame:
    """The database's names; of one organism, if the options name it (partitions of others are not read)."""
    names = reference.names
    if options.tax_id is None:
        return names
    if "tax_id" not in names.columns:
        raise ValueError(f"the names of {options.database!r} are not by organism")
    return names.filter(F.col("tax_id") == options.tax_id)


def search(queries: DataFrame, references: dict[str, Reference], options: LinkOptions | None = None) -> DataFrame:
    """(query, db_id, name, confidence, rank, label) from the database of the options: exact matches, else partial
    ones, the first ``max_candidates``."""
    options = options or LinkOptions()
    reference = reference_for(references, options)
    return match.with_labels(match.ranked_search(queries, index_for(reference, options), options), reference.labels)


def candidates(mentions: DataFrame, references: dict[str, Reference], options: LinkOptions | None = None) -> DataFrame:
    """(entity_id, db_id, score, cand_pos) of mentions (entity_id, synonyms), by the database, organism and method of
    the options. Genes have no vectors, so their method is always ``direct``."""
    options = options or LinkOptions()
    reference = reference_for(references, options)
    if options.search_method == "direct":
        return match.direct_match(mentions, index_for(reference, options), options)
    if reference.vectors is None or reference.embedder is None:
        raise ValueError(f"no vectors for database {options.database!r}")
    asked = mentions.filter(~match.is_unknown(F.col("synonyms"))).select("entity_id", F.posexplode("synonyms").alias("syn_pos", "name"))
    asked = asked.withColumn("query_id", F.concat_ws("\u001f", "entity_id", F.col("syn_pos").cast("string")))
    queries = providers.embed(asked.select(F.col("query_id").alias("doc_id"), F.lit(None).cast("string").alias("db_id"), "name"), reference.embedder)
    found = vector.nearest(queries.select(F.col("doc_id").alias("query_id"), "embedding"), reference.vectors, options.top_k, options.metric)
    found = found.join(reference.vectors.select("doc_id", "db_id"), "doc_id")
    ranked = vector.two_level(found, asked.select("query_id", "entity_id", "syn_pos"), options)
    return ranked.select("entity_id", "db_id", "score", (F.col("rank") - 1).alias("cand_pos"))


def _key(model: str = "file") -> Column:
    return F.concat_ws("\u001f", model, "entity_id")


def build_prompts(models: DataFrame, chosen: DataFrame, options: LinkOptions, rules: DataFrame | None = None) -> DataFrame:
    """(model, system_prompt, prompt) of each file: names of the chosen entities (file, entity_id, display_name, ord),
    reactions that name one of them, or for ``qual`` genes the boolean rules (``rules``: file, line), and notes."""
    targets = chosen.select("file", "entity_id")
    if options.entity_type == "gene":
        facts = context.transitions(rules, targets, model="file").select("file", F.concat("target", F.lit(" = "), "rule").alias("fact")) if rules is not None else None
    else:
        said = models.select("file", F.explode(readers.model_reactions(F.col("reactions"))).alias("reaction"))
        facts = context.touching(said, targets, "file").select("file", F.col("reaction").alias("fact"))
    named = chosen.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", "entity_id", "display_name"))).alias("x"))
    rows = models.join(named, "file")
    if facts is not None:
        rows = rows.join(facts.groupBy("file").agg(F.array_sort(F.collect_list("fact")).alias("facts")), "file", "left")
    else:
        rows = rows.withColumn("facts", F.lit(None).cast("array<string>"))
    names = F.transform("x", lambda e: F.when(F.coalesce(e["display_name"], F.lit("")) == "", e["entity_id"]).otherwise(F.concat(e["entity_id"], F.lit(" ("), e["display_name"], F.lit(")"))))
    text = lambda kind: context.user_prompt(F.col("model"), names, F.coalesce("facts", F.array().cast("array<string>")), drop_boilerplate(strip_tags(F.coalesce("notes", F.lit("")))), kind)
    prompt = F.when(F.lit(options.entity_type) == "chemical", text("chemical")).when(F.col("format") == "qual", text("qual_gene")).otherwise(text("gene"))
    return rows.select(F.col("file").alias("model"), context.system_prompt(F.lit(options.entity_type)).alias("system_prompt"), prompt.alias("prompt"))


def related(models: DataFrame, chosen: DataFrame) -> DataFrame:
    """(file, entity_id): the chosen entities and all that stand with one of them in a reaction."""
    said = models.select("file", F.explode(readers.model_reactions(F.col("reactions"))).alias("reaction"))
    named = context.touching(said, chosen.select("file", "entity_id"), "file").select("file", F.explode(identifiers(F.col("reaction"))).alias("entity_id"))
    return chosen.select("file", "entity_id").unionByName(named).distinct()


def _link(documents: DataFrame, provider: SynonymProvider | None, saved: DataFrame | None, references: dict[str, Reference], options: LinkOptions, work: str | None, curate: bool, rules: DataFrame | None) -> Linked:
    reference = reference_for(references, options)
    kind = options.entity_type
    models = readers.parse_models(documents).withColumn("listed", readers.entity_array(kind))
    annotated_ones = F.filter("listed", lambda e: F.size(readers.annotated_ids(e["annotation"], F.lit(kind))) > 0)
    models = models.withColumn("noted", F.transform(annotated_ones, lambda e: e["entity_id"]))
    every = readers.entities(models, kind)
    known = readers.existing_annotations(every).select("file", "entity_id", "db_id")
    noted = lambda e: F.array_contains("noted", e["entity_id"])
    chosen = readers.entities(models.withColumns({c: F.filter(c, noted) for c in ("species", "products", "qualitative")}), kind) if curate else every
    chosen = workflow.limit_entities(chosen, options.max_entities, "file")
    if saved is None:
        answers = _kept(parse_responses(providers.ask(build_prompts(models, chosen, options, rules), provider)).withColumnRenamed("model", "file"), work, "answers")
        told = answers
    else:  # no prompt is needed; answers of other files meet no entity below
        told = parse_responses(saved.select("model", "raw_response")).withColumnRenamed("model", "file")
        answers = told.join(chosen.select("file").distinct(), "file", "left_semi")
    answered = told.select("file").distinct()
    asked = chosen.join(answered, "file", "left_semi").select("file", "entity_id", "display_name", _key().alias("key"))
    mentions = match.with_default_synonym(asked, told, ("file", "entity_id")).select(F.col("key").alias("entity_id"), "synonyms")
    found = candidates(mentions, references, options)
    named = asked.select(basename(F.col("file")).alias("file"), F.lit(kind).alias("type"), F.col("key").alias("id"), "display_name")
    table = workflow.recommendation_table(named, found, known.select(_key().alias("entity_id"), "db_id"), reference.labels, options, curate=curate)
    table = table.withColumn("id", F.element_at(F.split("id", "\u001f"), -1))
    counted = F.filter("listed", noted) if curate else F.col("listed")
    totals = models.select("file", "parse_status", F.coalesce(F.array_size(counted), F.lit(0)).cast("long").alias("total_entities"))
    totals = totals.join(answered.withColumn("answered", F.lit(True)), "file", "left")
    status = F.when(F.col("parse_status") != "ok", F.col("parse_status")).when(F.col("total_entities") == 0, "no entities").when(F.col("answered").isNull(), "no answer").otherwise("ok")
    totals = totals.select(basename(F.col("file")).alias("file"), status.alias("status"), "total_entities")
    annotated = known.select(basename(F.col("file")).alias("file"), F.col("entity_id").alias("id"))
    return Linked(table, workflow.metrics_by(table, "file", totals, annotated, curate=curate), answers)


def annotate(documents: DataFrame, provider: SynonymProvider | None, references: dict[str, Reference], options: LinkOptions | None = None, work: str | None = None, rules: DataFrame | None = None, saved: DataFrame | None = None) -> Linked:
    """Recommendations for all entities of the options' type. Saved answers (model: the file, raw_response) can stand
    in for a provider."""
    return _link(documents, provider, saved, references, options or LinkOptions(), work, False, rules)


def curate(documents: DataFrame, provider: SynonymProvider | None, references: dict[str, Reference], options: LinkOptions | None = None, work: str | None = None, rules: DataFrame | None = None, saved: DataFrame | None = None) -> Linked:
    """Recommendations for the entities that have annotations; none is added."""
    return _link(documents, provider, saved, references, options or LinkOptions(), work, True, rules)


def annotate_folder(spark: SparkSession, path: str, provider: SynonymProvider, references: dict[str, Reference], options: LinkOptions | None = None, work: str | None = None) -> Linked:
    """``annotate`` for the ``.xml`` files of a folder, from ``start_at`` on, ``num_models`` of them."""
    options = options or LinkOptions()
    return annotate(readers.read_documents(spark, path, options.start_at, options.num_models, "*.xml"), provider, references, options, work)


def curate_folder(spark: SparkSession, path: str, provider: SynonymProvider, references: dict[str, Reference], options: LinkOptions | None = None, work: str | None = None) -> Linked:
    options = options or LinkOptions()
    return curate(readers.read_documents(spark, path, options.start_at, options.num_models, "*.xml"), provider, references, options, work)


def with_reference_ids(documents: DataFrame, references: dict[str, Reference], options: LinkOptions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parsed models, the entities that can be evaluated, and their ids (file, entity_id, db_id): chemical entities
    count if one of their ids has a formula."""
    reference = reference_for(references, options)
    models = readers.parse_models(documents)
    every = readers.entities(models, options.entity_type)
    known = readers.existing_annotations(every).select("file", "entity_id", "db_id")
    if options.entity_type == "chemical":
        if reference.formulas is None:
            raise ValueError(f"no formulas for database {options.database!r}")
        known = evaluate.with_any_formula(known.withColumn("key", _key()), reference.formulas, "key").drop("key")
    return models, every.join(known.select("file", "entity_id").distinct(), ["file", "entity_id"], "left_semi"), known


def _evaluated(asked: DataFrame, known: DataFrame, answers: DataFrame, references: dict[str, Reference], options: LinkOptions, times: DataFrame | None) -> DataFrame:
    """The evaluation table of entities (file, entity_id, ord) with their reference ids and parsed answers."""
    reference = reference_for(references, options)
    asked = asked.join(answers.select("file").distinct(), "file", "left_semi").withColumn("key", _key())
    told = answers.select("file", "entity_id", F.col("synonyms").alias("synonyms_LLM"), "reason")
    mentions = match.with_default_synonym(asked.select("file", "entity_id", "key"), answers, ("file", "entity_id"))
    found = candidates(mentions.select(F.col("key").alias("entity_id"), "synonyms"), references, options).withColumnRenamed("entity_id", "key")
    named = match.with_labels(found, reference.labels)
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("cand_pos", c))), lambda x: x[c])
    predicted = named.groupBy("key").agg(in_order("db_id").alias("predictions"), in_order("label").alias("predictions_names"), in_order("score").alias("match_score"))
    ids = known.withColumn("key", _key()).select("key", "db_id")
    refs = match.with_labels(ids, reference.labels).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("db_id", "label"))).alias("x"))
    refs = refs.select("key", F.col("x.db_id").alias("exist_annotation_id"), names_or_na(F.col("x.label")).alias("exist_annotation_name"))
    reasons = told.groupBy("file").agg(F.first("reason").alias("reason"))
    rows = mentions.select("file", "entity_id", "key", F.element_at("synonyms", 1).alias("first_name")).join(predicted, "key", "left").join(refs, "key", "left")
    rows = rows.join(told.drop("reason"), ["file", "entity_id"], "left").join(reasons, "file")
    if options.entity_type == "chemical":
        by_formula = lambda pairs, name: evaluate.formulas_of(pairs, reference.formulas, "key").withColumnRenamed("formulas", name)
        rows = rows.join(by_formula(ids, "ref_formulas"), "key", "left").join(by_formula(found.select("key", "db_id"), "pred_formulas"), "key", "left")
    none = F.array().cast("array<string>")
    text = {c: F.coalesce(F.col(c), none) for c in ("synonyms_LLM", "exist_annotation_id", "predictions", "predictions_names")}
    rows = rows.withColumns(text).withColumn("match_score", F.coalesce("match_score", F.array().cast("array<double>")))
    zeros = F.transform("predictions", lambda _: F.lit(0.0))
    rows = rows.withColumn("match_score", F.when(F.size("synonyms_LLM") == 0, zeros).otherwise(F.col("match_score")))
    own = rows.withColumns({"ref": F.col("exist_annotation_id"), "pred": F.col("predictions")})
    if options.entity_type == "chemical":
        exact = evaluate.recall_precision(own)
        exact = exact.withColumnsRenamed({"recall": "recall_exact", "precision": "precision_exact"})
        exact = exact.withColumns({"ref": F.coalesce("ref_formulas", none), "pred": F.coalesce("pred_formulas", none)})
        rows = evaluate.recall_precision(exact).withColumnsRenamed({"recall": "recall_formula", "precision": "precision_formula"})
        accuracy = evaluate.accuracy_flag(F.col("recall_formula"))
    else:
        rows = evaluate.list_recall_precision(own).withColumnsRenamed({"recall": "recall_exact", "precision": "precision_exact"})
        rows = rows.withColumns({"recall_formula": F.lit(0.0), "precision_formula": F.lit(0.0)})
        accuracy = evaluate.accuracy_flag(F.col("recall_exact"))
    rows = rows.join(times, "file", "left") if times is not None else rows.withColumn("llm_time", F.lit(None).cast("double"))
    return rows.select(
        basename(F.col("file")).alias("model"), F.col("entity_id").alias("species_id"), F.col("first_name").alias("display_name"), "synonyms_LLM", "reason", "exist_annotation_id",
        F.coalesce("exist_annotation_name", F.lit("NA")).alias("exist_annotation_name"), "predictions", "predictions_names", "match_score", "recall_formula", "precision_formula", "recall_exact",
        "precision_exact", accuracy.alias("accuracy"), "llm_time",
    )


def evaluate_models(documents: DataFrame, provider: SynonymProvider, references: dict[str, Reference], options: LinkOptions | None = None, work: str | None = None, rules: DataFrame | None = None) -> Linked:
    """The evaluation table (one row an entity that has reference ids) and a status for each model. Times of a single
    call have no meaning in a job over many models, so ``llm_time`` is null."""
    options = options or LinkOptions()
    models, chosen, known = with_reference_ids(documents, references, options)
    chosen = workflow.limit_entities(chosen, options.max_entities, "file")
    answers = _kept(parse_responses(providers.ask(build_prompts(models, chosen, options, rules), provider)).withColumnRenamed("model", "file"), work, "answers")
    table = _evaluated(chosen, known, answers, references, options, None)
    status = models.select("file", "parse_status").join(chosen.groupBy("file").agg(F.count("*").alias("entities")), "file", "left")
    status = status.join(answers.select("file").distinct().withColumn("answered", F.lit(True)), "file", "left")
    why = F.when(F.col("parse_status") != "ok", F.col("parse_status")).when(F.col("entities").isNull(), "no annotations").when(F.col("answered").isNull(), "no answer").otherwise("ok")
    return Linked(table, status.select(basename(F.col("file")).alias("file"), why.alias("status")), answers)


def evaluate_folder(spark: SparkSession, path: str, provider: SynonymProvider, references: dict[str, Reference], options: LinkOptions | None = None, work: str | None = None) -> Linked:
    options = options or LinkOptions()
    return evaluate_models(readers.read_documents(spark, path, options.start_at, options.num_models, "*.xml"), provider, references, options, work)


def replay(saved: DataFrame, documents: DataFrame, previous: DataFrame, references: dict[str, Reference], options: LinkOptions | None = None) -> Linked:
    """Evaluate saved answers (model, content) anew, for the entities of ``previous`` results (model, species_id,
    llm_time). Files that cannot be used are in ``metrics``, with the reason in ``status``."""
    options = options or LinkOptions()
    body = saved.select("model", saved_body(F.col("content")).alias("raw_response"), F.col("content").rlike(r"(?s)(RESULT:|Synonyms:)").alias("readable"))
    answers = parse_responses(body.filter("readable")).withColumnRenamed("model", "file")
    before = previous.select(F.col("model").alias("file"), F.col("species_id").alias("entity_id"), "llm_time")
    _, _, known = with_reference_ids(documents, references, options)
    known = known.withColumn("file", basename(F.col("file")))
    asked = before.select("file", "entity_id").distinct()
    times = before.groupBy("file").agg(F.first("llm_time", ignorenulls=True).alias("llm_time"))
    table = _evaluated(asked, known, answers, references, options, times)
    there = before.select(F.col("file").alias("model")).distinct().withColumn("there", F.lit(True))
    parsed = answers.select(F.col("file").alias("model")).distinct().withColumn("parsed", F.lit(True))
    why = F.when(~F.col("readable"), "no parseable content").when(F.col("there").isNull(), "not in previous results").when(F.col("parsed").isNull(), "no answer").otherwise("ok")
    status = body.select("model", "readable").join(there, "model", "left").join(parsed, "model", "left")
    return Linked(table, status.select(F.col("model").alias("file"), why.alias("status")), answers)
