"""Chemical formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _drop_atom(tokens: Column, atom: str) -> Column:
    """Drop the first token equal to ``atom``, and a number right after it."""
    at = F.array_position(tokens, atom).cast("int")
    number = F.coalesce(F.try_element_at(tokens, at + 1).rlike(r"^\d+$"), F.lit(False))
    kept = F.filter(tokens, lambda t, i: (i != at - 1) & ~((i == at) & number))
    return F.when(at > 0, kept).otherwise(tokens)


def shorten(formula: Column) -> Column:
    """A formula without its first H and first D token; 'H' if nothing is left."""
    tokens = F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?|\d+|.)"), F.lit(1))
    short = F.array_join(_drop_atom(_drop_atom(tokens, "H"), "D"), "")
    return F.when(short == "", "H").otherwise(short)


def shortest(formulas: Column) -> Column:
    """The shortest of the formulas, the first of equally long ones."""
    keyed = F.transform(formulas, lambda f, i: F.struct(F.length(f).alias("n"), i.alias("i"), f.alias("f")))
    return F.try_element_at(F.array_sort(keyed), F.lit(1))["f"]
