"""Whole workflows, from model files and saved answers to tables and figures."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from annoloom import workflows
from annoloom.operators import providers, vector
from annoloom.options import LinkOptions
from annoloom.sources import readers, writers

CHEBI = '<annotation><rdf:RDF xmlns:rdf="r"><rdf:li rdf:resource="http://identifiers.org/chebi/CHEBI:{}"/></rdf:RDF></annotation>'
MODEL = """<?xml version="1.0" encoding="UTF-8"?><sbml xmlns="http://s" level="3"><model id="m" name="Sugar &amp; co"><notes><body xmlns="h"><p>About sugar</p>\n<p>All rights reserved</p></body></notes>
<!-- <listOfSpecies><species id="never"/></listOfSpecies> --><listOfSpecies><species id="glc" name="Glucose">{}</species><species id="atp" name="ATP"/><species id="x"/></listOfSpecies>
<listOfReactions><reaction id="r1" reversible="false"><listOfReactants><speciesReference species="glc" stoichiometry="2.0"/><speciesReference species="x"/></listOfReactants>
<listOfProducts><speciesReference species="atp"/></listOfProducts></reaction><reaction id="r2"><listOfReactants><speciesReference species="x"/></listOfReactants></reaction></listOfReactions></model></sbml>"""
FBC = """<sbml xmlns:fbc="f"><model id="g"><listOfSpecies><species id="s1"/></listOfSpecies><fbc:listOfGeneProducts>
<fbc:geneProduct fbc:id="g1" fbc:name="" fbc:label="b1"><annotation>urn:miriam:ncbigene:12 http://identifiers.org/ncbigene/12</annotation></fbc:geneProduct>
<fbc:geneProduct fbc:id="g2" fbc:name="n2"/></fbc:listOfGeneProducts></model></sbml>"""
QUAL = """<sbml xmlns:qual="q"><model id="q"><qual:listOfQualitativeSpecies><qual:qualitativeSpecies qual:id="q1" qual:name=""/><qual:qualitativeSpecies qual:id="q2" qual:name="&lt;Q2&gt;">
<annotation>urn:miriam:ncbigene:34</annotation></qual:qualitativeSpecies></qual:listOfQualitativeSpecies><qual:listOfTransitions><qual:transition qual:id="t"/></qual:listOfTransitions></model></sbml>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("models")
    files = {"a.xml": MODEL.format(CHEBI.format(17)), "b.xml": FBC, "c.xml": QUAL, "d.xml": MODEL[:400], "e.xml": "not xml", "f.xml": "<sbml></sbml>", "g.xml": " ", "h.txt": MODEL}
    for name, body in files.items():
        (where / name).write_text(body)
    return str(where)


@pytest.fixture(scope="module")
def references(spark):
    names = [("glucose", "17", 0, 1), ("dextrose", "17", 0, 2), ("glucose", "18", 1, 1), ("atp", "30", 0, 3)]
    chebi = workflows.Reference(
        spark.createDataFrame(names, "name string, db_id string, id_pos int, name_ord long"),
        spark.createDataFrame([("17", "D-glucose"), ("30", "adenosine triphosphate")], "db_id string, label string"),
        spark.createDataFrame([("17", "C6H12O6"), ("18", "C6H12O6"), ("30", "")], "db_id string, formula string"),
        providers.embed(spark.createDataFrame([("17_0", "17", "glucose"), ("30_0", "30", "atp"), ("40_0", "40", "citrate")], "doc_id string, db_id string, name string"), providers.hashed_trigrams),
        providers.hashed_trigrams,
    )
    genes = [("b1", "12", 0, 1, "9606"), ("b1", "99", 0, 1, "10090"), ("q2", "34", 0, 2, "9606")]
    ncbi = workflows.Reference(spark.createDataFrame(genes, "name string, db_id string, id_pos int, name_ord long, tax_id string"), spark.createDataFrame([("12", "B1")], "db_id string, label string"))
    return {"chebi": chebi, "ncbigene": ncbi}


class Scripted:
    """Answers by what a prompt holds."""

    def __init__(self, *answers):
        self.answers = answers

    def open(self):
        return lambda systems, prompts: [next((a for part, a in self.answers if part in p), "") for p in prompts]


CHEMICAL = Scripted(("Sugar & co", 'glc: "Glucose", "dextrose"\natp: "ATP"\nReason: known'))
GENES = Scripted(("b1", 'g1: "b1"\ng2: "UNK"\nReason: r'), ("<Q2>", 'q2: "Q2"\nReason: s'))


def test_models_are_read_by_format(spark, folder):
    models = readers.parse_models(readers.read_documents(spark, folder, pattern="*.xml"))
    got = {r["file"][-5]: r for r in models.collect()}
    assert {k: r["parse_status"] for k, r in got.items()} == {"a": "ok", "b": "ok", "c": "ok", "d": "malformed", "e": "malformed", "f": "no model", "g": "malformed"}
    assert {k: r["format"] for k, r in got.items()} == {"a": "plain", "b": "fbc", "c": "qual", "d": "plain", "e": "plain", "f": "plain", "g": "plain"}
    counts = ("num_species", "num_reactions", "num_gene_products", "num_qualitative_species", "num_transitions")
    assert [[got[k][c] for c in counts] for k in "abcd"] == [[3, 2, 0, 0, 0], [1, 0, 2, 0, 0], [0, 0, 0, 2, 1], [0] * 5]
    assert (got["a"]["model"], got["b"]["model"], got["e"]["model"]) == ("Sugar & co", "g", "")
    rows = readers.entities(models)
    shown = sorted((r["file"][-5], r["entity_type"], r["entity_id"], r["display_name"]) for r in rows.collect())
    assert shown == [
        ("a", "chemical", "atp", "ATP"), ("a", "chemical", "glc", "Glucose"), ("a", "chemical", "x", ""), ("b", "chemical", "s1", ""), ("b", "gene", "g1", "b1"), ("b", "gene", "g2", "n2"),
        ("c", "gene", "q1", "q1"), ("c", "gene", "q2", "<Q2>"),
    ]
    known = sorted((r["file"][-5], r["entity_id"], r["db_id"]) for r in readers.existing_annotations(rows).collect())
    assert known == [("a", "glc", "17"), ("b", "g1", "12"), ("c", "q2", "34")]
    assert got["a"]["reactions"] and models.filter("num_reactions > 0").select(readers.model_reactions(F.col("reactions")).alias("r")).first()["r"] == ["r1: 2 glc + x => atp"]


def test_slices_of_a_folder(spark, folder):
    names = lambda *a: sorted(r["file"][-5:] for r in readers.read_documents(spark, folder, *a, pattern="*.xml").collect())
    assert names() == [f"{c}.xml" for c in "abcdefg"]
    assert names(2, 2) == ["b.xml", "c.xml"] and names(6) == ["f.xml", "g.xml"] and names(9) == [] and names(1, 0) == [] and names(7, 5) == ["g.xml"]


def rows_of(table, *columns):
    return sorted((tuple(r[c] for c in columns) for r in table.collect()), key=str)


def test_annotate_chemicals(spark, folder, references):
    got = workflows.annotate_folder(spark, folder, CHEMICAL, references)
    columns = ("file", "type", "id", "display_name", "annotation", "annotation_label", "match_score", "existing", "update_annotation")
    assert rows_of(got.table, *columns) == [
        ("a.xml", "chemical", "atp", "ATP", "CHEBI:30", "adenosine triphosphate", 1.0, 0, "add"), ("a.xml", "chemical", "glc", "Glucose", "CHEBI:17", "D-glucose", 1.0, 1, "keep"),
        ("a.xml", "chemical", "glc", "Glucose", "CHEBI:18", "18", 0.5, 0, "ignore"), ("a.xml", "chemical", "x", "", "", "", 0.0, 0, "ignore"),
    ]
    figures = {r["file"][0]: r for r in got.metrics.collect()}
    assert {k: r["status"] for k, r in figures.items()} == {"a": "ok", "b": "no answer", "c": "no entities", "d": "malformed", "e": "malformed", "f": "no model", "g": "malformed"}
    a = figures["a"]
    assert (a["total_entities"], a["entities_with_predictions"], a["total_predictions"], a["matches"], round(a["annotation_rate"], 3), a["accuracy"]) == (3, 2, 3, 1, 0.667, 1.0)
    assert figures["e"]["accuracy"] is None and figures["e"]["total_entities"] == 0
    few = workflows.annotate_folder(spark, folder, CHEMICAL, references, LinkOptions(max_entities=1, num_models=1, add_threshold=1.0))
    assert rows_of(few.table, "id", "update_annotation") == [("glc", "ignore"), ("glc", "keep")] and few.metrics.count() == 1


def test_curate_and_genes(spark, folder, references):
    got = workflows.curate_folder(spark, folder, CHEMICAL, references)
    assert rows_of(got.table, "id", "annotation", "update_annotation") == [("glc", "17", "keep"), ("glc", "18", "ignore")]
    assert {r["file"][0]: (r["total_entities"], r["accuracy"]) for r in got.metrics.filter("status = 'ok'").collect()} == {"a": (1, 1.0)}
    human = workflows.annotate_folder(spark, folder, GENES, references, LinkOptions(database="ncbigene", tax_id="9606"))
    assert rows_of(human.table, "file", "id", "annotation", "existing") == [("b.xml", "g1", "NCBIGENE:12", 1), ("b.xml", "g2", "", 0), ("c.xml", "q1", "", 0), ("c.xml", "q2", "NCBIGENE:34", 1)]
    mouse = workflows.annotate_folder(spark, folder, GENES, references, LinkOptions(database="ncbigene", tax_id="10090", method="rag"))
    assert rows_of(mouse.table.filter("annotation <> ''"), "id", "annotation") == [("g1", "NCBIGENE:99")]


def test_rag_uses_the_stored_vectors(spark, folder, references, tmp_path):
    chebi = references["chebi"]
    names = spark.createDataFrame([("17_0", "17", "glucose"), ("17_1", "17", "dextrose"), ("30_0", "30", "atp"), ("40_0", "40", "citrate")], "doc_id string, db_id string, name string")
    writers.write_vectors(names, providers.embedder_for("default"), str(tmp_path / "v"))
    stored = workflows.Reference(chebi.names, chebi.labels, chebi.formulas, spark.read.parquet(str(tmp_path / "v")), providers.embedder_for("default"))
    for metric in ("l2sq", "cosine"):
        got = workflows.annotate_folder(spark, folder, CHEMICAL, {"chebi": stored}, LinkOptions(method="rag", top_k=1, metric=metric))
        assert rows_of(got.table.filter("annotation <> ''"), "id", "annotation", "match_score")[:2] == [("atp", "CHEBI:30", 1.0), ("glc", "CHEBI:17", 1.0)]
    queries = spark.createDataFrame([("a", [1.0] + [0.0] * 63), ("b", None)], "query_id string, embedding array<double>")
    found = vector.nearest(queries, stored.vectors, 2)
    assert [r["doc_id"] is None for r in vector.best_match(queries, found).orderBy("query_id").collect()] == [False, True]
    assert "BatchEvalPython" not in found._jdf.queryExecution().toString()


def test_evaluate_and_replay(spark, folder, references, tmp_path):
    got = workflows.evaluate_folder(spark, folder, CHEMICAL, references)
    row = got.table.collect()
    assert [(r["model"], r["species_id"], r["display_name"], r["exist_annotation_id"], r["exist_annotation_name"], r["predictions"], r["match_score"], r["recall_exact"], r["precision_exact"]) for r in row] == [
        ("a.xml", "glc", "Glucose", ["17"], "D-glucose", ["17", "18"], [1.0, 0.5], 1.0, 0.5)
    ]
    assert (row[0]["recall_formula"], row[0]["precision_formula"], row[0]["accuracy"], row[0]["reason"]) == (1.0, 1.0, 1, "known")
    genes = workflows.evaluate_folder(spark, folder, GENES, references, LinkOptions(database="ncbigene", tax_id="9606"))
    assert rows_of(genes.table, "species_id", "recall_exact", "accuracy", "recall_formula") == [("g1", 1.0, 1, 0.0), ("q2", 1.0, 1, 0.0)]
    answers = got.answers.select(F.lit("a").alias("model"), F.lit("m").alias("llm"), F.current_timestamp().alias("saved_at"), "entity_id", "synonyms", "reason", "line_no")
    where = tmp_path / "saved"
    where.mkdir()
    (where / "a.txt").write_text(writers.response_text(answers).first()["value"])
    (where / "b.txt").write_text("Model: b\n\nSynonyms:\ns1: ['x']\n\nReason: r")
    (where / "c.txt").write_text("nothing")
    previous = spark.createDataFrame([("a.xml", "glc", 2.5), ("c.xml", "q", 1.0)], "model string, species_id string, llm_time double")
    again = workflows.replay(readers.read_saved_responses(spark, str(where)), readers.read_documents(spark, folder, pattern="*.xml"), previous, references)
    assert rows_of(again.table, "model", "species_id", "predictions", "accuracy", "llm_time") == [("a.xml", "glc", ["17", "18"], 1, 2.5)]
    assert rows_of(again.metrics, "file", "status") == [("a.xml", "ok"), ("b.xml", "not in previous results"), ("c.xml", "no parseable content")]


def test_prompts_hold_the_context(spark, folder):
    models = readers.parse_models(readers.read_documents(spark, folder, pattern="*.xml"))
    rules = spark.createDataFrame([("q2, q1 & q9",), ("q7, q8",), ("q1, q1",)], "line string").crossJoin(models.filter("format = 'qual'").select("file"))
    for database, rule in (("chebi", None), ("ncbigene", rules)):
        options = LinkOptions(database=database)
        chosen = readers.entities(models, options.entity_type)
        text = {r["model"][-5]: r["prompt"] for r in workflows.build_prompts(models, chosen, options, rule).collect()}
        if rule is None:
            assert "r1: 2 glc + x => atp" in text["a"] and "glc (Glucose), atp (ATP), x" in text["a"] and "About sugar" in text["a"] and "rights" not in text["a"]
            assert rows_of(workflows.related(models, chosen.filter("entity_id = 'atp'")), "entity_id") == [("2",), ("atp",), ("glc",), ("r1",), ("x",)]
        else:
            assert "q2 = q1 & q9" in text["c"] and "q7" not in text["c"] and "g1 (b1), g2 (n2)" in text["b"]


def test_search_by_database_and_unknown_names(spark, references):
    queries = spark.createDataFrame([("Glu-cose",), ("b",), ("zz",)], "query string")
    assert rows_of(workflows.search(queries, references), "query", "db_id", "label", "rank") == [("Glu-cose", "17", "D-glucose", 1), ("Glu-cose", "18", "18", 2)]
    genes = workflows.search(queries, references, LinkOptions(database="ncbigene", tax_id="10090", max_candidates=1))
    assert rows_of(genes, "query", "db_id", "confidence") == [("b", "99", 0.5)]
    for wrong in ({"database": "uniprot"}, {"method": "guess"}, {"metric": "l1"}):
        with pytest.raises(ValueError):
            LinkOptions(**wrong)
    with pytest.raises(ValueError):
        workflows.search(queries, references, LinkOptions(tax_id="1"))
    with pytest.raises(ValueError):
        workflows.search(queries, {}, LinkOptions())
    with pytest.raises(ValueError):
        providers.provider_for("no-such-model")
    with pytest.raises(ValueError):
        providers.embedder_for("no-such-embedder")


class Service(http.server.BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/embeddings":
            out = {"data": [{"index": i, "embedding": [float(len(x))]} for i, x in enumerate(body["input"])]}
        elif "fail" in body["messages"][1]["content"]:
            self.send_response(500)
            self.end_headers()
            return
        else:
            out = {"choices": [{"message": {"content": f"{body['model']} {body['temperature']} {body['max_tokens']} {body['messages'][1]['content']}"}}]}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(out).encode())

    def log_message(self, *_):
        pass


def test_services_by_model_name(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        address = f"http://127.0.0.1:{server.server_port}"
        provider = providers.provider_for("small", {"small": (address, "NO_KEY")})
        prompts = spark.createDataFrame([("m", "s", "hello"), ("n", "s", "fail")], "model string, system_prompt string, prompt string")
        assert rows_of(providers.ask(prompts, provider), "model", "raw_response") == [("m", "small 0.2 10000 hello"), ("n", "")]
        assert providers.ServiceEmbedder("e", address, "NO_KEY")(["a", "abc"]) == [[1.0], [3.0]]
    finally:
        server.shutdown()


def test_saved_answers_need_few_parses(spark, sf):
    """Every mention of a document's parse in the plan is work done anew."""
    from annoloom.plans import catalogue

    for name, most in (("annotate_workflow", 3), ("curate_workflow_figures", 4)):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count("from_xml") <= most


def test_curated_figures_of_odd_documents(spark):
    """Entities of one id, without an id, without annotations, and documents without answers."""
    noted, plain = CHEBI.format(5), "<annotation/>"
    species = f'<species id="a">{noted}</species><species id="a">{plain}</species><species>{noted}</species><species id="b">{plain}</species>'
    shape = "<sbml><model id='m'><listOfSpecies>{}</listOfSpecies></model></sbml>"
    documents = spark.createDataFrame([("x/1.xml", shape.format(species)), ("x/2.xml", shape.format("")), ("x/3.xml", "<sbml"), ("x/4.xml", shape.format(species))], "file string, content string")
    names = spark.createDataFrame([("sugar", "5", 0, 0)], "name string, db_id string, id_pos int, name_ord int")
    labels = spark.createDataFrame([("5", "Sugar")], "db_id string, label string")
    saved = spark.createDataFrame([("x/1.xml", 'a: "sugar"'), ("x/2.xml", 'a: "sugar"'), ("x/9.xml", 'a: "sugar"')], "model string, raw_response string")
    run = workflows.curate(documents, None, {"chebi": workflows.Reference(names, labels)}, saved=saved)
    got = {r["file"]: (r["status"], r["total_entities"]) for r in run.metrics.collect()}
    assert got == {"1.xml": ("ok", 2), "2.xml": ("no entities", 0), "3.xml": ("malformed", 0), "4.xml": ("no answer", 2)}
    assert [r["file"] for r in run.answers.collect()] == ["x/1.xml"]
