"""Parsers of model answers and of saved answers. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoloom.functions.text import list_literal, strip


def strip_fences(text: Column) -> Column:
    """Without code fences."""
    return strip(F.regexp_replace(text, r"```[A-Za-z]*", ""))


def reason_line(lines: Column) -> Column:
    """Number of the first line that begins with ``reason:`` in either case, from 1; 0 if none does."""
    return F.array_position(F.transform(lines, lambda x: F.startswith(F.lower(strip(x)), F.lit("reason:"))), True).cast("int")


def names_of(part: Column) -> Column:
    """Quoted names, then the bare comma parts; a printed list is read as such."""
    quoted = F.regexp_extract_all(part, F.lit('"([^"]*)"'), F.lit(1))
    bare = F.split(F.regexp_replace(part, '"[^"]*"', ""), ",")
    plain = F.filter(F.transform(F.concat(quoted, bare), strip), lambda s: s != "")
    return F.when(strip(part).rlike(r"^\[.*\]$"), F.coalesce(list_literal(strip(part)), plain)).otherwise(plain)


def parse_responses(answers: DataFrame, key: str = "model", text: str = "raw_response", *, keep_after_reason: bool = False) -> DataFrame:
    """(key, entity_id, synonyms, line_no, reason): one row an entity; of repeated ids the last line wins. Text
    after the first reason line is reason, unless ``keep_after_reason`` lets later ``id: names`` lines count."""
    lines = answers.select(key, F.split(strip_fences(F.coalesce(F.col(text), F.lit(""))), "\n").alias("lines"))
    at = reason_line(F.col("lines"))
    lines = lines.withColumn("at", at)
    said = F.array_join(F.slice("lines", F.greatest(F.col("at"), F.lit(1)), F.size("lines")), "\n")
    reason = F.when(F.col("at") > 0, strip(F.regexp_replace(strip(said), r"(?i)^reason:", ""))).otherwise("")
    body = F.col("lines") if keep_after_reason else F.when(F.col("at") > 0, F.slice("lines", 1, F.col("at") - 1)).otherwise(F.col("lines"))
    rows = lines.select(key, reason.alias("reason"), F.posexplode(body).alias("line_no", "line")).filter(F.contains("line", F.lit(":")))
    if keep_after_reason:
        rows = rows.filter(~F.startswith(F.lower(strip(F.col("line"))), F.lit("reason:")))
    parts = F.split("line", ":", 2)
    entity = strip(F.regexp_replace(strip(parts[0]), r"^[\"']|[\"']$", ""))
    rows = rows.select(key, "reason", "line_no", entity.alias("entity_id"), names_of(parts[1]).alias("synonyms")).filter("entity_id <> ''")
    return rows.groupBy(key, "entity_id").agg(F.max_by("synonyms", "line_no").alias("synonyms"), F.max("line_no").alias("line_no"), F.first("reason").alias("reason"))


def saved_body(content: Column) -> Column:
    """The answer in a saved file: its ``RESULT:`` part, else synonyms and first reason rejoined."""
    result = F.regexp_extract(content, r"(?s)RESULT:\s*(.*)$", 1)
    synonyms = strip(F.regexp_extract(content, r"(?s)Synonyms:[^\n]*\n(.*?)(?=\nReason:|$)", 1))
    reason = strip(F.regexp_extract(content, r"(?s)\nReason:(.*)$", 1))
    return F.when(result != "", result).otherwise(F.concat(synonyms, F.lit("\nReason: "), reason))


def saved_header(content: Column, name: str) -> Column:
    return F.regexp_extract(content, rf"(?m)^{name}:\s*(.*?)\s*$", 1)
