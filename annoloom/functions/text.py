"""Column functions over text: extraction, cleaning, tokens. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Uri patterns by database, each capturing the digits of the id.
NCBIGENE_URI_PATTERNS = (r"http[s]?://identifiers\.org/ncbigene/(\d+)", r"urn:miriam:ncbigene:(\d+)")
CHEBI_URI_PATTERNS = (r"http[s]?://identifiers\.org/chebi/CHEBI:(\d+)", r"urn:miriam:chebi:CHEBI:(\d+)")
# Words that mark boilerplate lines of model notes.
BOILERPLATE_WORDS = (
    "copyright", "public domain", "rights", "CC0", "dedication", "please refer", "BioModels Database", "cite", "citing", "terms of use",
    "Li C", "BMC Syst", "encoded model", "entitled to use", "redistribute", "commercially", "restricted way", "verbatim", "BIOMD", "resource",
)


def extract_all(text: Column, patterns: tuple[str, ...]) -> Column:
    """First groups of all matches of all patterns: distinct, sorted."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def split_lines(text: Column) -> Column:
    """Split at line ends and at runs of two or more white-space characters."""
    return F.split(text, r"\n|\s{2,}")


def strip(text: Column) -> Column:
    """Remove white space (all of Unicode's) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def drop_boilerplate(text: Column, words: tuple[str, ...] = BOILERPLATE_WORDS) -> Column:
    """Stripped non-empty lines that contain none of the words in either case, joined by line ends."""
    lines = F.transform(split_lines(text), strip)

    def wanted(line: Column) -> Column:
        low, keep = F.lower(line), line != ""
        for w in words:
            keep = keep & ~F.contains(low, F.lit(w.lower()))
        return keep

    return F.array_join(F.filter(lines, wanted), "\n")


def normalise_name(name: Column) -> Column:
    """Lower case, then only a-z, A-Z and digits."""
    return F.regexp_replace(F.lower(name), "[^a-zA-Z0-9]", "")


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)"), F.lit(1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def clean(value: Column) -> Column:
    """Trimmed; null, '', '-' and 'nan' are null."""
    value = F.trim(value)
    return F.when(~F.coalesce(value, F.lit("")).isin("", "-", "nan"), value)


def split_synonyms(names: Column, symbol: Column) -> Column:
    """Parts of a pipe list that are neither empty nor '-' nor the symbol, first occurrences."""
    parts = F.transform(F.split(F.coalesce(names, F.lit("")), r"[|]"), lambda s: F.trim(s))
    return F.array_distinct(F.filter(parts, lambda s: ~s.isin("", "-") & (s != F.coalesce(symbol, F.lit("")))))


def strip_prefix(value: Column, prefix: str = "CHEBI:") -> Column:
    return F.replace(value, F.lit(prefix), F.lit(""))


def names_or_na(names: Column) -> Column:
    joined = F.array_join(names, ", ")
    return F.when(joined != "", joined).otherwise("NA")


def list_literal(text: Column) -> Column:
    """Strings of a printed list, with single or double quotes; null if it is none."""
    return F.from_json(text, "array<string>")


def display_name(name: Column, label: Column, entity_id: Column) -> Column:
    """Name, else label, else id."""
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(name), filled(label), entity_id)


def document_id(db_id: Column, ordinal: Column) -> Column:
    return F.concat(db_id.cast("string"), F.lit("_"), ordinal.cast("string"))
