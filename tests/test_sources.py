"""Sources, sinks, providers, parsers, streaming, on small files that the tests write."""

import duckdb
import pytest
from pyspark.sql import functions as F

from annoloom import schemas
from annoloom.functions import response, text
from annoloom.functions.formula import shorten
from annoloom.operators import catalogue, context, index, match, providers, workflow
from annoloom.sources import readers, writers
from annoloom.streaming.replay import replay_stream

FBC = '<sbml xmlns:fbc="f"><model id="m"><listOfSpecies><species id="s1" name="Glc"/></listOfSpecies><fbc:listOfGeneProducts><fbc:geneProduct fbc:id="g1" fbc:name="" fbc:label="b1"><annotation>urn:miriam:ncbigene:12 http://identifiers.org/ncbigene/12</annotation></fbc:geneProduct></fbc:listOfGeneProducts></model></sbml>'
PLAIN = '<sbml><model><species id="s1" name="glucose"><annotation><a r="http://identifiers.org/chebi/CHEBI:17"/></annotation></species><species id="s2"/></model></sbml>'
SAVED = "Model: A.xml\nLLM: m\nTimestamp: 2025-01-02 03:04:05\n\nSynonyms:\ns1: ['a', \"b's, c\"]\ns2: ['UNK']\n\nReason: first\nReason: x: y"


def test_model_documents(spark, tmp_path):
    for name, body in (("a.xml", FBC), ("b.xml", PLAIN), ("c.xml", "not xml")):
        (tmp_path / name).write_text(body)
    docs = readers.read_documents(spark, str(tmp_path))
    rows = readers.entities(readers.parse_models(docs))
    got = {(r["file"][-5:], r["format"], r["entity_type"], r["entity_id"]) for r in rows.collect()}
    assert got == {("a.xml", "fbc", "gene", "g1"), ("a.xml", "fbc", "chemical", "s1"), ("b.xml", "plain", "chemical", "s1"), ("b.xml", "plain", "chemical", "s2")}
    assert {(r["file"][-5:], r["entity_id"], r["db_id"]) for r in readers.existing_annotations(rows).collect()} == {("a.xml", "g1", "12"), ("b.xml", "s1", "17")}
    assert [r["file"][-5:] for r in readers.read_documents(spark, str(tmp_path), 2, 1).collect()] == ["b.xml"]
    bad = readers.parse_models(docs)
    writers.write_dead_letters(bad, str(tmp_path / "dead"))
    assert [r["file"][-5:] for r in spark.read.json(str(tmp_path / "dead")).collect()] == ["c.xml"]


def test_ontology_and_genes(spark, tmp_path):
    (tmp_path / "o.xml").write_text(
        '<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:oboInOwl="i" xmlns:rdfs="s" xmlns:chebi="c"><owl:Class><oboInOwl:id>CHEBI:1</oboInOwl:id><rdfs:label>Water</rdfs:label>'
        "<oboInOwl:hasExactSynonym>H2O</oboInOwl:hasExactSynonym><oboInOwl:hasExactSynonym>aqua</oboInOwl:hasExactSynonym><chebi:formula>H2O</chebi:formula>"
        "<oboInOwl:hasAlternativeId>CHEBI:9</oboInOwl:hasAlternativeId></owl:Class><owl:Class><rdfs:label>none</rdfs:label></owl:Class></rdf:RDF>"
    )
    classes = readers.read_ontology(spark, str(tmp_path / "o.xml"))
    assert [(r["id"], r["label"], r["exact_synonym"], r["alternative_id"]) for r in classes.collect()] == [("1", "Water", ["H2O", "aqua"], ["9"])]
    assert {tuple(r) for r in index.secondary_to_primary(classes).collect()} == {("1", "1"), ("9", "1")}
    (tmp_path / "g.tsv").write_text("#tax_id\tGeneID\tSymbol\tSynonyms\ttype_of_gene\tdescription\n9606\t1\tA1\tX|-|A1\tprotein-coding\td\n10\t2\t-\t-\tncRNA\td\n")
    genes = index.clean_gene_info(readers.read_gene_info(spark, str(tmp_path / "g.tsv"), 2))
    assert {(r["tax_id"], r["db_id"], tuple(r["names"])) for r in genes.collect()} == {("9606", "1", ("A1", "X")), ("10", "2", ())}
    rows = genes.select("tax_id", "db_id", F.explode("names").alias("name"), F.lit(0).alias("ord"))
    built = index.exploded_index(rows, ("tax_id",)).withColumn("name_ord", F.lit(0).cast("long"))
    writers.write_name_index(built, str(tmp_path / "index"))
    assert {(r["db_id"], tuple(r["names"])) for r in readers.read_id_names(spark, str(tmp_path / "index"), "9606").collect()} == {("1", ("a1", "x"))}
    labels = spark.createDataFrame([("1", "A1")], schemas.LABELS)
    writers.write_labels(labels, str(tmp_path / "labels"))
    writers.write_formulas(labels.withColumnRenamed("label", "formula"), str(tmp_path / "formulas"))
    assert readers.read_labels(spark, str(tmp_path / "labels")).collect() == labels.collect()
    assert readers.read_formulas(spark, str(tmp_path / "formulas")).first()["formula"] == "A1"
    pruned = readers.read_name_index(spark, str(tmp_path / "index"), "9606")
    assert {r["name"] for r in pruned.collect()} == {"a1", "x"}
    assert "PartitionFilters: [isnotnull(tax_id" in pruned._jdf.queryExecution().toString()
    assert catalogue.available(spark, {"a": str(tmp_path / "index"), "b": str(tmp_path / "no")}) == {"a": True, "b": False}


def test_responses(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.txt").write_text(SAVED)
    (tmp_path / "in" / "B.txt").write_text("Model: B\n\nSynonyms:\n\n\nReason: none")
    saved = readers.read_saved_responses(spark, str(tmp_path / "in"))
    parsed = response.parse_responses(saved.select("model", response.saved_body(F.col("content")).alias("raw_response")))
    assert {(r["model"], r["entity_id"], tuple(r["synonyms"])) for r in parsed.collect()} == {("A.xml", "s1", ("a", "b's, c")), ("A.xml", "s2", ("UNK",))}
    assert saved.select(response.saved_header(F.col("content"), "LLM").alias("x")).filter("x <> ''").first()["x"] == "m"
    replay_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    (tmp_path / "in" / "C.txt").write_text(SAVED)
    replay_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {r["model"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"A.xml", "C.xml"}
    out = parsed.withColumn("llm", F.lit("m")).withColumn("saved_at", F.to_timestamp(F.lit("2025-01-02 03:04:05")))
    assert writers.response_text(out).first()["value"].startswith("Model: A.xml\nLLM: m\nTimestamp: 2025-01-02 03:04:05\n\nSynonyms:\ns1: ['a', ")
    raw = [("m", 'x: "a, b", c\nx: d\nno colon\nReason: because\ny: e')]
    answers = spark.createDataFrame(raw, "model string, raw_response string")
    assert [(r["entity_id"], r["synonyms"]) for r in response.parse_responses(answers).collect()] == [("x", ["d"])]
    assert {r["entity_id"] for r in response.parse_responses(answers, keep_after_reason=True).collect()} == {"x", "y"}


@pytest.mark.parametrize("formula,short", [("C6H12O6", "C6O6"), ("H2", "H"), ("HgCl2", "HgCl2"), ("D2O", "O"), ("CH3OH", "COH"), ("HO4H", "O4H")])
def test_formula(spark, formula, short):
    assert spark.range(1).select(shorten(F.lit(formula)).alias("x")).first()["x"] == short


def test_partial_pairs_equal_the_nested_loop(spark, sf):
    con = duckdb.connect()
    names = [r[0] for r in con.execute(f"SELECT DISTINCT lower(p_name) FROM '{sf}/part.parquet'").fetchall()]
    queries = ["a", "ed", "red", "bolt", "xredyboltz", "small widget and more", "", "zz", *names[:5]]
    got = match.partial_pairs(spark.createDataFrame([(q,) for q in queries], "q string"), spark.createDataFrame([(n,) for n in [*names, "re", ""]], "ref string"))
    want = sorted((q, n) for q in set(queries) - {""} for n in {*names, "re"} if q in n or n in q)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_providers_and_sinks(spark, tmp_path):
    prompts = spark.createDataFrame([("m", "s", "p"), ("n", "s", "q")], "model string, system_prompt string, prompt string")
    answers = {r["model"]: r["raw_response"] for r in providers.ask(prompts, providers.StaticProvider({"p": "x: y"})).collect()}
    assert answers == {"m": "x: y", "n": ""}
    names = spark.createDataFrame([("1_0", "1", "ab")], "doc_id string, db_id string, name string")
    writers.write_vectors(names, lambda ts: [[float(len(t)), 1.0] for t in ts], str(tmp_path / "v"))
    assert spark.read.schema(schemas.VECTORS).parquet(str(tmp_path / "v")).first()["embedding"] == [2.0, 1.0]
    rows = spark.createDataFrame([("m", ["a"])], "model string, predictions array<string>")
    writers.write_results(rows, str(tmp_path / "csv"), "csv")
    assert readers.read_results(spark, str(tmp_path / "csv"), "model string, predictions string", "csv").first()["predictions"] == '["a"]'
    writers.write_results(rows, str(tmp_path / "pq"), by_model=True)
    assert (tmp_path / "pq" / "model=m").is_dir()
    bad = spark.createDataFrame([("a", "ok"), ("b", "no colon")], "model string, parse_status string")
    writers.write_dead_letters(bad, str(tmp_path / "dead"))
    assert spark.read.json(str(tmp_path / "dead")).count() == 1


def test_actions_and_context(spark):
    row = spark.range(1).select(
        workflow.annotate_action(F.lit(0), F.lit(0), F.lit(0.5), 0.5).alias("a"), workflow.annotate_action(F.lit(1), F.lit(3), F.lit(0.1), 0.5).alias("b"),
        context.reactions(F.lit("// Reactions:\n A => B; C => D;\n// end")).alias("c"), context.system_prompt(F.lit("odd")).alias("d"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == ("ignore", "keep", ["A => B", "C => D"], context.SYSTEM_PROMPTS["chemical"])
    rows = spark.createDataFrame([("m", "A => B1"), ("m", "B => C")], "model string, reaction string")
    targets = spark.createDataFrame([("m", "B")], "model string, entity_id string")
    assert [r["reaction"] for r in context.touching(rows, targets).collect()] == ["B => C"]
