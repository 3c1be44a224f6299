"""Nearest neighbours. Queries are a stated set; they meet the vectors block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annoloom.functions.vector import similarity
from annoloom.options import LinkOptions

#: Queries and vectors of a block; two blocks are matched by one matrix product.
BLOCK, VECTORS = 1024, 4096


def _packed(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Rows (id, embedding) as rows of up to VECTORS of them: ids and one flat list of numbers."""
    for batch in batches:
        for at in range(0, batch.num_rows, VECTORS):
            part = batch.slice(at, VECTORS)
            flat = part.column("embedding").flatten().cast(pa.float64())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (part.column(name), flat)]
            yield pa.RecordBatch.from_arrays(lists, names=["ids", "numbers"])


def _distances(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    dots = q @ v.T
    if metric == "l2sq":
        return np.maximum((q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * dots, 0.0)
    return 1 - dots / np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] * (v * v).sum(axis=1)[None, :], 1e-300))


def _top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, metric: str, exclude_same: bool) -> Iterator[tuple]:
    """(query id, id, distance) of the k lowest distances for each query, ties by id. The matrix product finds
    candidates, with room for its rounding; their distances are then taken from the differences."""
    rough = _distances(q, v, metric)
    if exclude_same:
        rough[q_ids[:, None] == ids[None, :]] = np.inf
    room = 1e-9 * (np.abs(q).max(initial=1.0) ** 2 + np.abs(v).max(initial=1.0) ** 2) * v.shape[1] + 1e-6 if metric == "l2sq" else 1e-6
    edge = np.partition(rough, k - 1, axis=1)[:, k - 1] if rough.shape[1] > k else np.full(len(q), np.inf)
    for n, row in enumerate(rough):
        near = np.flatnonzero((row <= edge[n] + room) & np.isfinite(row))
        exact = ((v[near] - q[n]) ** 2).sum(axis=1) if metric == "l2sq" else row[near]
        exact = np.round(np.maximum(exact, 0.0), 6)
        for j in np.lexsort((ids[near], exact))[:k]:
            yield q_ids[n], ids[near[j]], float(exact[j])


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2sq", *, exclude_same: bool = False) -> DataFrame:
    """(query_id, doc_id, distance, rank): the k nearest of ``vectors`` (doc_id, embedding) to each of ``queries``
    (query_id, embedding), by exact distances rounded to six places, ties by id; ids keep their types. Vectors
    are read once and packed into block rows, which a join on the block number brings to each query block (Spark
    broadcasts the query blocks where their size allows). Each pair of blocks gives k rows a query, so what is
    shuffled is neither all pairs nor anything at the driver."""
    q_type, d_type = queries.schema["query_id"].dataType, vectors.schema["doc_id"].dataType
    rows = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding IS NOT NULL AND query_id IS NOT NULL")
    blocks = max(1, -(-rows.count() // BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    asked = rows.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("query_id", "embedding"))).alias("q"))
    asked = asked.select("block", F.col("q.query_id").alias("q_ids"), F.flatten("q.embedding").alias("q_numbers"))
    held = vectors.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding IS NOT NULL AND doc_id IS NOT NULL")
    packed = held.mapInArrow(lambda batches: _packed(batches, "doc_id"), f"ids array<{d_type.simpleString()}>, numbers array<double>")
    pairs = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(asked, "block").select("ids", "numbers", "q_ids", "q_numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                ids, numbers, q_ids, q_numbers = (batch.column(c)[n].values for c in ("ids", "numbers", "q_ids", "q_numbers"))
                q = q_numbers.to_numpy(zero_copy_only=False).reshape(len(q_ids), -1)
                v = numbers.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                found = list(_top(np.asarray(q_ids.to_pylist()), q, np.asarray(ids.to_pylist()), v, k, metric, exclude_same))
                a, b, d = zip(*found, strict=True) if found else ((), (), ())
                plain = lambda xs: [x.item() for x in xs]
                yield pa.RecordBatch.from_arrays([pa.array(plain(a), q_ids.type), pa.array(plain(b), ids.type), pa.array(d, pa.float64())], names=["query_id", "doc_id", "distance"])

    out = pairs.mapInArrow(run, f"query_id {q_type.simpleString()}, doc_id {d_type.simpleString()}, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_match(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, doc_id, confidence): the nearest of each query, null where there is none."""
    first = found.filter("rank = 1").select("query_id", "doc_id", similarity(F.col("distance")).alias("confidence"))
    return queries.select("query_id").distinct().join(first, "query_id", "left")


def two_level(found: DataFrame, owners: DataFrame, options: LinkOptions | None = None) -> DataFrame:
    """(entity_id, db_id, score, rank): neighbours (query_id, doc_id, distance, rank) of the synonyms of
    entities (``owners``: query_id, entity_id, syn_pos), best rounded score for each candidate id, the first
    ``top_k`` ids by score, then by first sight."""
    options = options or LinkOptions()
    rows = found.join(owners, "query_id").withColumn("score", similarity(F.col("distance")))
    best = rows.groupBy("entity_id", "db_id").agg(F.max("score").alias("score"), F.min(F.struct("syn_pos", "rank")).alias("seen"))
    order = Window.partitionBy("entity_id").orderBy(F.desc("score"), "seen", "db_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= options.top_k).drop("seen")
