"""Typed options with the defaults of the annotation workflows."""

from __future__ import annotations

from dataclasses import dataclass


#: Databases: id prefix, entity type, methods.
DATABASES = {"chebi": ("CHEBI:", "chemical", ("direct", "rag")), "ncbigene": ("NCBIGENE:", "gene", ("direct",))}


@dataclass(frozen=True)
class LinkOptions:
    """add_threshold: least score, exclusive, at which the first candidate is added. method: ``direct`` (names) or
    ``rag`` (vectors; genes have names alone). metric: ``l2sq`` (squared Euclidean distance) or ``cosine``.
    tax_id: organism whose names count. max_entities: of each model, 0 for all. start_at, num_models: slice of a
    folder. compat: only lower-case index names, as gene lookups once did."""

    add_threshold: float = 0.5
    top_k: int = 5
    max_candidates: int = 10
    max_entities: int = 0
    metric: str = "l2sq"
    database: str = "chebi"
    method: str = "direct"
    tax_id: str | None = None
    compat: bool = False
    start_at: int = 1
    num_models: int | None = None

    def __post_init__(self) -> None:
        if self.database not in DATABASES:
            raise ValueError(f"database {self.database!r} is not one of {sorted(DATABASES)}")
        if self.method not in ("direct", "rag"):
            raise ValueError(f"method {self.method!r} is neither 'direct' nor 'rag'")
        if self.metric not in ("l2sq", "cosine"):
            raise ValueError(f"metric {self.metric!r} is neither 'l2sq' nor 'cosine'")

    def prefix(self) -> str:
        return DATABASES[self.database][0]

    @property
    def entity_type(self) -> str:
        return DATABASES[self.database][1]

    @property
    def search_method(self) -> str:
        """The method, or ``direct`` where the database has no other."""
        return self.method if self.method in DATABASES[self.database][2] else "direct"
