"""Annotation and curation tables and their figures, for many models at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annoloom.options import LinkOptions


def limit_entities(entities: DataFrame, max_entities: int | None, model: str = "model", ord_: str = "ord") -> DataFrame:
    """The first ``max_entities`` of each model in document order; 0 or None keeps all."""
    if not max_entities:
        return entities
    return entities.withColumn("_n", F.row_number().over(Window.partitionBy(model).orderBy(ord_))).filter(F.col("_n") <= max_entities).drop("_n")


def annotate_action(existing: Column, cand_pos: Column, score: Column, threshold: float) -> Column:
    return F.when(existing == 1, "keep").when((cand_pos == 0) & (score > threshold), "add").otherwise("ignore")


def curate_action(existing: Column) -> Column:
    return F.when(existing == 1, "keep").otherwise("ignore")


def recommendation_table(entities: DataFrame, candidates: DataFrame, existing: DataFrame, labels: DataFrame, options: LinkOptions | None = None, *, curate: bool = False) -> DataFrame:
    """One row an entity and candidate, one row for an entity without a candidate. ``entities``: (file, type, id,
    display_name); ``candidates``: (entity_id, db_id, score, cand_pos); ``existing``: (entity_id, db_id), bare
    ids. Ids are compared bare; annotation prefixes them, curation does not."""
    options = options or LinkOptions()
    known = existing.select(F.col("entity_id").alias("id"), "db_id").distinct().withColumn("existing", F.lit(1))
    named = labels.select("db_id", F.col("label").alias("annotation_label"))
    rows = entities.join(candidates.withColumnRenamed("entity_id", "id"), "id", "left").join(known, ["id", "db_id"], "left").join(named, "db_id", "left")
    return shown_table(rows.withColumn("existing", F.coalesce("existing", F.lit(0))), options, curate=curate)


def shown_id(options: LinkOptions | None = None, *, curate: bool = False) -> dict[str, Column]:
    """How a table shows an id (db_id, annotation_label): its name and its label."""
    options = options or LinkOptions()
    text = F.col("db_id").cast("string")
    name = text if curate else F.concat(F.lit(options.prefix()), text)
    return {"annotation": F.coalesce(name, F.lit("")), "shown_label": F.when(text.isNotNull(), F.coalesce("annotation_label", text)).otherwise("")}


def shown_score(digits: int | None = None) -> dict[str, Column]:
    """How a table shows a score: rounded to ``digits``, 0 if there is none."""
    return {"match_score": F.coalesce("score" if digits is None else F.round("score", digits), F.lit(0.0))}


def shown_table(rows: DataFrame, options: LinkOptions | None = None, *, curate: bool = False) -> DataFrame:
    """The columns of a recommendation table, from rows of entities with (db_id, score, cand_pos, existing,
    annotation_label). Columns of ``shown_id`` and ``shown_score`` that the rows have are taken as they are."""
    options = options or LinkOptions()
    action = curate_action(F.col("existing")) if curate else annotate_action(F.col("existing"), F.col("cand_pos"), F.col("score"), options.add_threshold)
    shown = {c: F.col(c) if c in rows.columns else made for c, made in (shown_id(options, curate=curate) | shown_score()).items()}
    return rows.select(
        "file", "type", "id", "display_name",
        shown["annotation"].alias("annotation"),
        shown["shown_label"].alias("annotation_label"),
        shown["match_score"].alias("match_score"),
        F.col("existing").cast("int").alias("existing"),
        action.alias("update_annotation"),
    )


def predictions(table: DataFrame) -> tuple[Column, Column]:
    """Whether a row has a prediction, and the number of all, of a recommendation table or one of counts."""
    if "candidates" in table.columns:
        return F.col("candidates") > 0, F.coalesce(F.sum("candidates"), F.lit(0)).cast("long")
    predicted = F.col("annotation") != ""
    return predicted, F.count(F.when(predicted, 1))


def metrics(table: DataFrame, *, curate: bool = False, annotated: DataFrame | None = None) -> DataFrame:
    """One row of figures. Accuracy: matching entities over entities with existing annotations (``annotated``:
    id); in curation, matching rows over entities with predictions, which can exceed 1. The table can be one of
    counts (``folded.counted_table``)."""
    predicted, total = predictions(table)
    one = table.agg(
        F.countDistinct("id").alias("total_entities"),
        F.countDistinct(F.when(predicted, F.col("id"))).alias("entities_with_predictions"),
        total.alias("total_predictions"),
        F.coalesce(F.sum("existing"), F.lit(0)).cast("long").alias("matches"),
        F.countDistinct(F.when(F.col("existing") > 0, F.col("id"))).alias("matched_entities"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    one = one.withColumn("annotation_rate", F.coalesce(share("entities_with_predictions", "total_entities"), F.lit(0.0)))
    if curate:
        return one.withColumn("accuracy", share("matches", "entities_with_predictions")).drop("matched_entities")
    known = annotated.agg(F.countDistinct("id").alias("known"))
    return one.crossJoin(F.broadcast(known)).withColumn("accuracy", share("matched_entities", "known")).drop("matched_entities", "known")


def metrics_by(table: DataFrame, by: str, models: DataFrame, annotated: DataFrame, *, curate: bool = False) -> DataFrame:
    """One row of figures for each of ``models`` (by, total_entities): those of ``metrics``, with the accuracy of
    ``annotated`` (by, id) entities. A model without rows has figures of 0."""
    predicted = F.col("annotation") != ""
    figures = table.groupBy(by).agg(
        F.countDistinct(F.when(predicted, F.col("id"))).alias("entities_with_predictions"),
        F.count(F.when(predicted, 1)).alias("total_predictions"),
        F.sum("existing").cast("long").alias("matches"),
        F.countDistinct(F.when(F.col("existing") == 1, F.col("id"))).alias("matched_entities"),
    )
    known = annotated.groupBy(by).agg(F.countDistinct("id").alias("known"))
    counts = ("entities_with_predictions", "total_predictions", "matches", "matched_entities", "known")
    one = models.join(figures, by, "left").join(known, by, "left").na.fill(0, list(counts))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    one = one.withColumn("annotation_rate", F.coalesce(share("entities_with_predictions", "total_entities"), F.lit(0.0)))
    accuracy = share("matches", "entities_with_predictions") if curate else share("matched_entities", "known")
    return one.withColumn("accuracy", accuracy).drop("matched_entities", "known")
