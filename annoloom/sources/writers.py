"""Sinks: results, indexes by organism, saved answers, dead letters, vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoloom.operators.providers import Embedder, embed


def write_results(rows: DataFrame, path: str, fmt: str = "parquet", by_model: bool = False) -> None:
    """Results as Parquet, JSON or CSV (CSV: arrays as JSON text); ``by_model`` makes a folder a model."""
    if fmt == "csv":
        rows = rows.withColumns({f.name: F.to_json(f.name) for f in rows.schema if f.dataType.typeName() == "array"})
    writer = rows.write.mode("overwrite").format(fmt).option("header", True)
    (writer.partitionBy("model") if by_model else writer).save(path)


def write_name_index(index: DataFrame, path: str) -> None:
    """A name index in folders by organism, sorted by name inside, so lookups prune both."""
    index.repartition("tax_id").sortWithinPartitions("name").write.mode("overwrite").partitionBy("tax_id").parquet(path)


def write_labels(labels: DataFrame, path: str) -> None:
    labels.select("db_id", "label").write.mode("overwrite").parquet(path)


def write_formulas(formulas: DataFrame, path: str) -> None:
    formulas.select("db_id", "formula").write.mode("overwrite").parquet(path)


def response_text(rows: DataFrame) -> DataFrame:
    """(model, llm, value): saved form of parsed answers (model, llm, saved_at, entity_id, synonyms, reason)."""
    line = F.format_string("%s: [%s]", F.col("entity_id"), F.array_join(F.transform("synonyms", lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", "))
    by = rows.groupBy("model", "llm").agg(
        F.max("saved_at").alias("saved_at"), F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))).alias("lines"), F.first("reason").alias("reason")
    )
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    stamp = F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss")
    return by.select("model", "llm", F.format_string("Model: %s\nLLM: %s\nTimestamp: %s\n\nSynonyms:\n%s\n\nReason: %s", "model", "llm", stamp, body, "reason").alias("value"))


def write_responses(rows: DataFrame, path: str) -> None:
    response_text(rows).write.mode("overwrite").partitionBy("llm", "model").text(path)


def write_dead_letters(parsed: DataFrame, path: str) -> None:
    """Rows (of ``parse_models``, say) whose status is not ok."""
    parsed.filter("parse_status <> 'ok'").write.mode("overwrite").json(path)


def write_vectors(names: DataFrame, embedder: Embedder, path: str) -> None:
    """Vectors of (doc_id, db_id, name); the embedder gets Arrow batches."""
    embed(names, embedder).write.mode("overwrite").parquet(path)
