"""Reference tables in a folder: layout, opening, vector collections, linking."""

import pytest

from annoloom import reference, workflows
from annoloom.options import LinkOptions


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    names = spark.createDataFrame([("Glucose", "17", 1), ("dextrose", "17", 2), ("glucose", "18", 3), ("ATP", "30", 4), (" ", "31", 5)], "name string, db_id string, ord int")
    labels = spark.createDataFrame([("17", "old", 1), ("17", "D-glucose", 2), ("30", "ATP", 1)], "db_id string, label string, ord int")
    reference.write_reference(names, labels, where, "chebi", spark.createDataFrame([("17", "C6H12O6")], "db_id string, formula string"))
    genes = spark.createDataFrame([("b1", "12", 1, "9606"), ("b1", "99", 1, "10090")], "name string, db_id string, ord int, tax_id string")
    reference.write_reference(genes, spark.createDataFrame([("12", "B1", 1)], "db_id string, label string, ord int"), where, "ncbigene")
    reference.build_vectors(names, where, "chebi", reference.IndexOptions(batch_rows=2))
    return where


def rows_of(table, *columns):
    return sorted((tuple(r[c] for c in columns) for r in table.collect()), key=str)


def test_tables_are_found(spark, base):
    assert reference.databases(spark, base) == {"chebi": True, "ncbigene": True}
    chebi = reference.open_reference(spark, "chebi", base)
    assert rows_of(chebi.names, "name", "db_id", "id_pos", "name_ord") == [("atp", "30", 0, 4), ("dextrose", "17", 0, 2), ("glucose", "17", 0, 1), ("glucose", "18", 1, 3)]
    assert rows_of(chebi.labels, "db_id", "label") == [("17", "D-glucose"), ("30", "ATP")]
    assert rows_of(chebi.vectors, "doc_id", "name") == [("17_0", "Glucose"), ("17_1", "dextrose"), ("18_0", "glucose"), ("30_0", "ATP")]
    spark.conf.set(reference.SETTING, base)
    try:
        genes = {"ncbigene": reference.open_reference(spark, "ncbigene")}
        queries = spark.createDataFrame([("B-1",)], "query string")
        assert rows_of(workflows.search(queries, genes, LinkOptions(database="ncbigene", tax_id="10090")), "db_id") == [("99",)]
        assert genes["ncbigene"].formulas is None and genes["ncbigene"].vectors is None
    finally:
        spark.conf.unset(reference.SETTING)
    with pytest.raises(ValueError):
        reference.open_reference(spark, "chebi")
    with pytest.raises(ValueError):
        reference.open_reference(spark, "uniprot", base)
    with pytest.raises(FileNotFoundError):
        reference.open_reference(spark, "chebi", base + "/none")
    with pytest.raises(ValueError):
        reference.EntityLinker(genes["ncbigene"])


class Numbered:
    def __init__(self, answers):
        self.answers = answers

    def open(self):
        return lambda systems, prompts: [next((a for q, a in self.answers.items() if f"'{q}'" in p), "") for p in prompts]


def test_linker(spark, base):
    linker = reference.EntityLinker(reference.open_reference(spark, "chebi", base), top_k=2)
    mentions = spark.createDataFrame([("dextrose",), ("atp",), ("atp",), (None,)], "query string")
    assert rows_of(linker.link(mentions), "query", "db_id", "confidence") == [("atp", "30", 1.0), ("dextrose", "17", 1.0), (None, None, 0.0)]
    assert [r["rank"] for r in reference.smoke_search(linker, ["glucose"], 2).collect()] == [1, 2]
    said = linker.decide(spark.createDataFrame([(q,) for q in ("dextrose", "atp", "glucose", "sugar")], "query string"), Numbered({"dextrose": "1", "atp": "NONE", "glucose": "candidate 2.", "sugar": "7"}))
    assert [(q, d is not None) for q, d in rows_of(said, "query", "db_id")] == [("atp", False), ("dextrose", True), ("glucose", True), ("sugar", False)]


def test_a_sample_of_names_to_try_an_index(spark, tmp_path):
    names = spark.createDataFrame([(f"n{i}", str(i), i) for i in range(20)], "name string, db_id string, ord int")
    path = reference.build_vectors(names, str(tmp_path), "chebi", reference.IndexOptions("trial", sample=3))
    assert path.endswith("chebi/vectors/trial") and spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        reference.IndexOptions(batch_rows=0)
