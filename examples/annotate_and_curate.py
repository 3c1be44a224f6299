"""Annotate, then curate, the models of a folder: chemicals, or genes of one organism.

    python examples/annotate_and_curate.py MODELS REFERENCE_TABLES MODEL_NAME [TAX_ID]
"""

import sys

from pyspark.sql import SparkSession

from annoloom import workflows
from annoloom.operators.providers import provider_for
from annoloom.options import LinkOptions
from annoloom.reference import open_reference


def main(models: str, tables: str, model_name: str, tax_id: str | None = None) -> None:
    spark = SparkSession.builder.appName("annotate").getOrCreate()
    options = LinkOptions(database="ncbigene", tax_id=tax_id) if tax_id else LinkOptions()
    references = {options.database: open_reference(spark, options.database, tables)}
    provider = provider_for(model_name)
    for name, run in (("annotate", workflows.annotate_folder), ("curate", workflows.curate_folder)):
        found = run(spark, models, provider, references, options)
        print(name)
        found.table.orderBy("file", "id").show(50, truncate=False)
        found.metrics.orderBy("file").show(50, truncate=False)


if __name__ == "__main__":
    main(*sys.argv[1:])
