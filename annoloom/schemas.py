"""Schemas of the engine's tables."""

from __future__ import annotations

NAME_INDEX = "name string, db_id string, id_pos int, name_ord long, tax_id string"
LABELS = "db_id string, label string"
FORMULAS = "db_id string, formula string"
VECTORS = "doc_id string, db_id string, name string, embedding array<float>"
SYNONYMS = "model string, entity_id string, synonym string, syn_pos int"
GENE_INFO = "`#tax_id` string, GeneID string, Symbol string, Synonyms string, type_of_gene string, description string"
ONTOLOGY_CLASS = "id string, label string, exact_synonym array<string>, related_synonym array<string>, formula array<string>, alternative_id array<string>"
REC_TABLE = "file string, type string, id string, display_name string, annotation string, annotation_label string, match_score double, existing int, update_annotation string"
EVAL_TABLE = (
    "model string, species_id string, display_name string, synonyms_LLM array<string>, reason string, exist_annotation_id array<string>, "
    "exist_annotation_name string, predictions array<string>, predictions_names array<string>, match_score array<double>, recall_formula double, "
    "precision_formula double, recall_exact double, precision_exact double, accuracy int, total_time double, llm_time double, query_time double"
)
