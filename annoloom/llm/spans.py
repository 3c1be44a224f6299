"""Span columns: ``array<struct<kind,start,end,score,base>>``, offsets in code points, end exclusive."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoloom.llm.common import map_arrow, text_list, text_slices

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())])
OUT = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(SPAN))])
DDL = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"


def map_spans(docs: DataFrame, find: Callable[[str], list[tuple]]) -> DataFrame:
    """(doc_id, spans) with ``find`` applied to each whole text; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("kind", "start", "end", "score", "base")
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = [[dict(zip(keys, s, strict=True)) for s in find(t)] if t else [] for t in text_list(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, OUT.field("spans").type)], schema=OUT)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, DDL)


def joined(spans: Column | str, base_only: bool = False) -> Column:
    """``kind:start:end`` of the spans in their order, comma-joined."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    chosen = F.filter(spans, lambda s: s["base"]) if base_only else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(F.col(spans), lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def in_order(spans: list[tuple], kinds: tuple[str, ...]) -> list[tuple]:
    """By start, then kind as listed."""
    if len(spans) < 2:
        return spans
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


class Cover:
    """Whether a range touches any of some spans, in logarithmic time a question."""

    def __init__(self, spans: list[tuple]):
        ordered = sorted((s[1], s[2]) for s in spans)
        self.starts = [a for a, _ in ordered]
        self.reach = list(accumulate((b for _, b in ordered), max))

    def touches(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.reach[before - 1] > start
