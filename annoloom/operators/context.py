"""Context of models: reactions, transitions, neighbours, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoloom.functions.text import identifiers, strip


def statements(text: Column, section: str, arrow: str) -> Column:
    """``left arrow right`` statements of a section that ends at the next comment."""
    body = F.regexp_extract(text, rf"(?s)// {section}:(.*?)(?=//|$)", 1)
    parts = F.filter(F.slice(F.split(body, ";"), F.lit(1), F.greatest(F.size(F.split(body, ";")) - 1, F.lit(0))), lambda s: F.contains(s, F.lit(arrow)))
    sides = lambda s: F.split(s, arrow, 2)
    return F.transform(parts, lambda s: F.concat(strip(sides(s)[0]), F.lit(f" {arrow} "), strip(sides(s)[1])))


def reactions(text: Column) -> Column:
    """Reactions of a model text, else its rate rules."""
    found = statements(text, "Reactions", "=>")
    return F.when(F.size(found) > 0, found).otherwise(statements(text, "Rate Rules", "="))


def touching(rows: DataFrame, targets: DataFrame, model: str = "model", reaction: str = "reaction") -> DataFrame:
    """Reactions that name a target of their model as a whole word: a join on tokens."""
    tokens = rows.select(model, reaction, F.explode(F.array_distinct(identifiers(F.col(reaction)))).alias("entity_id"))
    return tokens.join(targets.select(model, "entity_id").distinct(), [model, "entity_id"], "left_semi").select(model, reaction).distinct()


def neighbours(members: DataFrame, targets: DataFrame, group: str, entity: str) -> DataFrame:
    """Distinct entities of the groups (reactions) that hold a target."""
    hit = members.join(targets.select(entity).distinct(), entity, "left_semi").select(group).distinct()
    return members.join(hit, group, "left_semi").select(entity).distinct()


def transitions(lines: DataFrame, targets: list[str] | DataFrame, line: str = "line", model: str = "model") -> DataFrame:
    """(target, rule) of ``target, rule`` lines without self loops, whose target is one of ``targets`` or whose
    rule holds one of them as a substring. A table of targets (model, entity_id) holds each model's own; a model's
    targets are those of one file."""
    if isinstance(targets, DataFrame):
        own = targets.groupBy(model).agg(F.array_sort(F.collect_set("entity_id")).alias("_targets"))
        lines = lines.join(own, model)
    else:
        lines = lines.withColumn("_targets", F.array(*map(F.lit, targets)).cast("array<string>"))
    parts = F.split(line, ",", 2)
    rows = lines.filter(F.contains(line, F.lit(","))).withColumn("target", strip(parts[0])).withColumn("rule", strip(parts[1])).filter("target <> rule")
    return rows.filter(F.exists("_targets", lambda t: (F.col("target") == t) | F.contains("rule", t))).drop("_targets")


def format_of(n_products: Column, n_qualitative: Column) -> Column:
    return F.when(n_products > 0, "fbc").when(n_qualitative > 0, "qual").otherwise("plain")


# Prompts are this engine's own.
SYSTEM_PROMPTS = {
    "chemical": "Give up to three common names for each chemical entity of the model. Answer one line an entity: id: \"name\", \"name\". Write UNK if unsure. Then: Reason: why.",
    "gene": "Give up to three official gene symbols for each entity of the model. Answer one line an entity: id: \"symbol\", \"symbol\". Write UNK if unsure. Then: Reason: why.",
}


def system_prompt(entity_type: Column) -> Column:
    """By entity type; unknown types count as chemical."""
    return F.when(entity_type == "gene", SYSTEM_PROMPTS["gene"]).otherwise(SYSTEM_PROMPTS["chemical"])


def user_prompt(model: Column, names: Column, facts: Column, notes: Column, kind: str = "chemical") -> Column:
    """Prompt text from a model's name, entity names, reactions or transitions, and notes."""
    what = {"chemical": "Reactions", "gene": "Reactions", "qual_gene": "Transitions"}[kind]
    return F.format_string(f"Model: %s\nEntities: %s\n{what}:\n%s\nNotes: %s", F.coalesce(model, F.lit("")), F.array_join(names, ", "), F.array_join(facts, "\n"), F.coalesce(notes, F.lit("")))


def candidate_lines(candidates: Column) -> Column:
    """Numbered lines of candidate structs (label, db_id, score)."""
    score = lambda c: F.when(c["score"].isNotNull(), F.format_string("%.3f", c["score"].cast("double")))
    return F.array_join(F.transform(candidates, lambda c, i: F.format_string("%d. %s (%s) score %s", i + 1, c["label"], c["db_id"].cast("string"), score(c))), "\n")


def linking_prompt(mention: Column, candidates: Column) -> Column:
    return F.format_string("Which candidate does '%s' mean?\n%s\nAnswer with its number or NONE.", mention, candidate_lines(candidates))
