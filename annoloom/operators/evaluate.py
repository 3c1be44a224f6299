"""Recall, precision, accuracy; summaries and comparisons of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annoloom.operators.workflow import predictions


def _share(both: Column, whole: Column) -> Column:
    return F.when(whole > 0, both / whole).otherwise(0.0)


def raw_recall(ref: Column, pred: Column) -> Column:
    return _share(F.size(F.array_intersect(ref, pred)), F.size(F.array_distinct(ref)))


def raw_precision(ref: Column, pred: Column) -> Column:
    return _share(F.size(F.array_intersect(ref, pred)), F.size(F.array_distinct(pred)))


def recall_precision(rows: DataFrame) -> DataFrame:
    """Adds recall and precision, to three places, to rows with arrays ``ref`` and ``pred``."""
    return rows.withColumn("recall", F.bround(raw_recall(F.col("ref"), F.col("pred")), 3)).withColumn("precision", F.bround(raw_precision(F.col("ref"), F.col("pred")), 3))


def mean_recall_precision(rows: DataFrame) -> DataFrame:
    """Means of the unrounded values, rounded; 0 without rows."""
    mean = lambda c: F.bround(F.coalesce(F.avg(c), F.lit(0.0)), 3)
    return rows.agg(mean(raw_recall(F.col("ref"), F.col("pred"))).alias("recall"), mean(raw_precision(F.col("ref"), F.col("pred"))).alias("precision"))


def list_recall_precision(rows: DataFrame) -> DataFrame:
    """Recall and precision with lengths that count repeats, not rounded."""
    both = F.size(F.array_intersect("ref", "pred"))
    return rows.withColumn("recall", _share(both, F.size("ref"))).withColumn("precision", _share(both, F.size("pred")))


def accuracy_flag(recall: Column) -> Column:
    return F.when(recall > 0, 1).otherwise(0)


def formulas_of(pairs: DataFrame, formulas: DataFrame, group: str) -> DataFrame:
    """(group, formulas): distinct non-empty formulas of each group's ids, sorted."""
    known = formulas.filter(F.col("formula") != "")
    return pairs.join(known, "db_id").groupBy(group).agg(F.array_sort(F.collect_set("formula")).alias("formulas"))


def with_any_formula(pairs: DataFrame, formulas: DataFrame, group: str) -> DataFrame:
    """All pairs of the groups that have an id with a formula."""
    known = pairs.join(formulas.filter(F.col("formula") != ""), "db_id", "left_semi").select(group).distinct()
    return pairs.join(known, group, "left_semi")


def summary(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Figures of an evaluation table (model, ord, accuracy, n_predictions, total_time, llm_time), for all of it or
    by run: means over models; a model's times are its
    first row's (of rows with equal ``ord``, the least); time for an element is the ratio of the means."""
    models = rows.groupBy(*by, "model").agg(
        F.avg("accuracy").alias("accuracy"), F.min(F.struct("ord", "total_time"))["total_time"].alias("total_time"), F.min(F.struct("ord", "llm_time"))["llm_time"].alias("llm_time"),
        F.count("*").alias("n"), F.sum("n_predictions").alias("predictions"), F.max((F.col("n_predictions") > 0).cast("int")).alias("predicted"),
    )
    total = models.groupBy(*by) if by else models.groupBy()
    out = total.agg(
        F.count("*").alias("models"), F.sum("predicted").cast("long").alias("models_with_predictions"), F.avg("accuracy").alias("mean_accuracy"), F.avg("total_time").alias("mean_total_time"),
        F.avg("llm_time").alias("mean_llm_time"), F.avg("n").alias("mean_elements"), (F.sum("predictions") / F.sum("n")).alias("mean_predictions"),
    )
    each = lambda c: F.when(F.col("mean_elements") > 0, F.col(c) / F.col("mean_elements"))
    return out.withColumn("total_time_per_element", each("mean_total_time")).withColumn("llm_time_per_element", each("mean_llm_time"))


def common_rows(runs: dict[str, DataFrame], keys: tuple[str, ...]) -> DataFrame:
    """All rows, with ``source``, whose key every run has: one pass over the runs and one shuffle."""
    tagged = reduce(DataFrame.unionByName, [r.withColumn("source", F.lit(name)) for name, r in runs.items()])
    seen = F.size(F.collect_set("source").over(Window.partitionBy(*keys)))
    return tagged.withColumn("_seen", seen).filter(F.col("_seen") == len(runs)).drop("_seen")


def compare_runs(runs: dict[str, DataFrame], keys: tuple[str, ...] = ("model", "species_id")) -> DataFrame:
    """A summary for each run, over the rows that all of them have."""
    return summary(common_rows(runs, keys), ("source",))


def replay(saved: DataFrame, previous: DataFrame, key: str = "model") -> tuple[DataFrame, DataFrame]:
    """Saved answers with their previous results, and those without any."""
    return saved.join(previous, key), saved.join(previous, key, "left_anti")


def simple_summary(table: DataFrame, by: str) -> DataFrame:
    """Entities, entities with a candidate, candidates and matches of a recommendation table, or one of counts."""
    predicted, total = predictions(table)
    return table.groupBy(by).agg(
        F.countDistinct("id").alias("entities"), F.countDistinct(F.when(predicted, F.col("id"))).alias("with_candidates"), total.alias("candidates"), F.sum("existing").cast("long").alias("matches")
    )
