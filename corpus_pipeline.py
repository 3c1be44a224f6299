"""The corpus pipeline: toxicity, near-duplicates, personal data, mixing, tokenisation.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``. ``run`` writes each stage's result as a
Parquet table in the shared folder and reads it back for the next.

Defined cases: a null text passes as empty text through the toxicity, personal-data and token stages and
is linked with nothing; further columns of ``docs`` are not carried; an empty table passes through.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annoloom.llm import bpe, minhash, mixing, pii, toxicity
from annoloom.llm.catalog import vocabulary_path
from annoloom.llm.common import load, materialise, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this corpus's labels, scores under 0.5."""
    model = toxicity.train_toxicity(docs, load(spark, sf_dir, "labels"))
    held = spark.sparkContext.broadcast(model)
    small_batches(spark)

    @F.pandas_udf(T.DoubleType())
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in parts:
            yield pd.Series(toxicity.score_texts(texts, held.value, known))

    docs = docs.select(*COLUMNS)
    return docs.withColumn("_score", score("text")).filter(F.col("_score") < 0.5).drop("_score")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates. Of rows that repeat one id with one set
    of shingles, and of rows without an id whose group has no other, one stays; rows without words all stay."""
    docs = docs.select(*COLUMNS)
    found = materialise(minhash.near_duplicates(docs, sets=True), "found")
    kept = found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = materialise(kept, "kept")
    once = kept.filter("n = 1").select("doc_id")
    named = docs.join(F.broadcast(once) if once.count() <= minhash.BROADCAST_IDS else once, "doc_id", "left_semi")
    again = docs.join(kept.filter("n > 1").select("doc_id"), "doc_id", "left_semi")
    nameless = docs.filter(F.col("doc_id").isNull())
    if again.isEmpty() and nameless.isEmpty():
        return named
    again, nameless = (minhash.with_sets(rows, "text") for rows in (again, nameless))
    alone = found.filter("kept AND doc_id IS NULL AND d0 IS NOT NULL").select("d0", "d1").distinct()
    worded = again.filter("d0 IS NOT NULL").unionByName(nameless.join(alone, ["d0", "d1"], "left_semi").select(*again.columns))
    one = worded.groupBy("doc_id", "d0", "d1").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    wordless = again.unionByName(nameless).filter("d0 IS NULL").select(*COLUMNS)
    return named.unionByName(one).unionByName(wordless)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each span of personal data replaced by its kind in brackets; n_chars follows."""

    small_batches(spark)

    @F.pandas_udf(T.StringType())
    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(pii.redact_text, na_action="ignore")

    redacted = docs.select(*COLUMNS).withColumn("text", redact("text"))
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of smaller sources again, up to half as often more; in the mixture's
    order."""
    mixed = mixing.mix(docs.select(*COLUMNS), max_repeats=1.5)
    return mixed.repartitionByRange("slot").sortWithinPartitions("slot").select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian, 32 bits) of every text, and their number."""
    encoded = bpe.encode_decode(docs, vocabulary_path())
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: SQL cannot express the classifier, the near-duplicate groups or the tokens; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
