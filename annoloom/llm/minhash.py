"""Near-duplicate grouping: b-bit MinHash candidates, confirmed on full shingle sets.

1. Each text gives its set of 5-word shingles (64-bit hashes), 128 minima, 32 band keys of four minima,
   and a signature of the two low bits of each minimum, packed in four longs.
2. Texts with equal sets form a class; the smallest doc_id represents it. Copies go no further.
3. In each band bucket, signatures are compared by bit counts of their difference. A pair whose
   collision-corrected similarity (and set sizes) leave the threshold possible joins a group. A small bucket
   is one unit of work and returns a spanning forest of its groups, not its pairs. In a large one all meet
   its few leaders first and those that a leader may be linked with are one group; only what stays apart is
   compared, in pairs of blocks, with all the bucket.
4. The groups are confirmed on full sets. A small group is one unit of work. A large one (in rows or in
   bytes) is dealt into chunks, each with the same few leaders; what stays apart from the largest part then
   meets all the group in pairs of blocks, by signatures first and, where these leave a link possible, on full
   sets. Within a unit, pairs already joined need no comparison; all others that the signature allows are
   compared exactly. No link between the groups' texts is left out.
5. Connected components of the confirmed links, by minimum labels with pointer jumping, give the result.

Leaders are the members with the smallest of a few hashes, so every large bucket and group has some. No step
gathers a group in one task or anything of all documents at the driver; labels that many rows share are
broadcast, not shuffled.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing;
fewer words than a shingle make one shingle of all; texts are read whole; only ``doc_id`` and ``text`` are
read; rows with the same doc_id count as one node; a row with a null doc_id is no node: it takes the
component of its class, or null, and is kept only if null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoloom.llm.common import HEAVY, map_arrow, materialise, mix64, release, skew_safe_lookup, span_hashes, text_bytes, text_slices, window_hashes, words_of

SHINGLE, PERCENT = 5, 75
HASHES, BANDS, LOW_BITS = 128, 32, 2
ROWS = HASHES // BANDS
#: Pairs with an estimate under this are not compared: five standard deviations below the threshold.
LEAST_ESTIMATE = 0.52
#: Rows of a bucket's block and of a unit, bytes of a unit's sets, leaders.
BLOCK, UNIT, UNIT_BYTES, LEADERS = 256, 256, 64 << 20, 4
#: Rows from which a join on labels looks for heavy ones first; fewer are small in one task, too.
MANY_ROWS = 1 << 20
#: Candidate ids up to this many are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_MULTIPLIER = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_OFFSET = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
SIGNATURE = [f"s{i}" for i in range(HASHES * LOW_BITS // 64)]
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d0", pa.int64()), ("d1", pa.int64()), *[(s, pa.int64()) for s in SIGNATURE], ("bands", pa.list_(pa.int64()))])
FEATURES_DDL = "doc_id long, n_shingles long, d0 long, d1 long, " + ", ".join(f"{s} long" for s in SIGNATURE) + ", bands array<long>"


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within each row, and the rows' bounds."""
    data, bounds = text_bytes(column)
    data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
    starts, ends, first = words_of(data, bounds)
    words = span_hashes(data, starts, ends)
    rows = len(first) - 1
    count = np.diff(first)
    row = np.repeat(np.arange(rows), count)
    hashes = window_hashes(words, SHINGLE)
    at = np.flatnonzero(row[: len(hashes)] == row[SHINGLE - 1 :][: len(hashes)]) if len(hashes) else np.zeros(0, np.int64)
    own, owner = [hashes[at]], [row[at]]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        value = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            there = count[short] > k
            word = words[np.minimum(first[short] + k, len(words) - 1)]
            value = np.where(there, value * np.uint64(0x100000001B3) + word, value)
        own.append(mix64(value + count[short].astype(np.uint64)))
        owner.append(short)
    own, owner = np.concatenate(own), np.concatenate(owner)
    order = np.lexsort((own, owner))
    own, owner = own[order], owner[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
    own, owner = own[fresh], owner[fresh]
    return own, np.searchsorted(owner, np.arange(rows + 1))


def _each_set(column: pa.Array) -> list[np.ndarray]:
    sets, bounds = shingle_sets(column)
    return [sets[a:b].copy() for a, b in zip(bounds, bounds[1:], strict=False)]


def set_digests(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128-bit digests of the rows with a set."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    size = np.diff(bounds)[full].astype(np.uint64)
    return np.stack([mix64(np.add.reduceat(mix64(sets ^ np.uint64(k)), bounds[:-1][full]) + size) for k in (0x5BD1E995, 0x1B873593)], axis=1)


def sketches(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the rows with a set: 128-bit digests, packed low bits, and band keys."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    starts = bounds[:-1][full]
    digest = set_digests(sets, bounds)
    minima = np.empty((len(full), HASHES), np.uint64)
    for k in range(HASHES):
        minima[:, k] = np.minimum.reduceat(sets * _MULTIPLIER[k] + _OFFSET[k], starts)
    minima = mix64(minima)
    low = minima & np.uint64((1 << LOW_BITS) - 1)
    shift = np.arange(0, 64, LOW_BITS, dtype=np.uint64)
    packed = np.stack([np.bitwise_or.reduce(x << shift, axis=1) for x in np.split(low, len(SIGNATURE), axis=1)], axis=1)
    bands = np.zeros((len(full), BANDS), np.uint64)
    for k in range(ROWS):
        bands = bands * np.uint64(0x100000001B3) + minima[:, k::ROWS]
    return digest, packed, mix64(bands + np.arange(BANDS, dtype=np.uint64))


def featurise(docs: DataFrame) -> DataFrame:
    """One row a document: set size, digest of the set, signature, band keys (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets, bounds = shingle_sets(part.column("text"))
                size = np.diff(bounds)
                full = np.flatnonzero(size > 0)
                index = np.full(len(size), -1)
                index[full] = np.arange(len(full))
                taken = pa.array(index, mask=index < 0)
                if len(full):
                    digest, packed, bands = sketches(sets, bounds)
                    columns = [*digest.T, *packed.T]
                    lists = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), pa.array(bands.ravel().view(np.int64)))
                else:
                    columns = [np.zeros(0, np.uint64)] * (2 + len(SIGNATURE))
                    lists = pa.array([], pa.list_(pa.int64()))
                arrays = [pa.array(np.ascontiguousarray(c).view(np.int64)).take(taken) for c in columns] + [lists.take(taken)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), *arrays], schema=FEATURES)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, FEATURES_DDL)


def with_sets(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with d0 and d1 of each text's set, null for empty sets."""

    @F.pandas_udf("d0 long, d1 long")
    def digests(texts: pd.Series) -> pd.DataFrame:
        sets, bounds = shingle_sets(pa.array(texts, pa.large_string()))
        full = np.diff(bounds) > 0
        out = np.zeros((len(texts), 2), np.int64)
        if full.any():
            out[full] = set_digests(sets, bounds).view(np.int64)
        return pd.DataFrame({c: pd.array(out[:, n], "Int64") for n, c in enumerate(("d0", "d1"))}).where(pd.Series(full), pd.NA)

    return docs.withColumn("_d", digests(text)).select("*", "_d.d0", "_d.d1").drop("_d")


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (last axis), corrected for chance collisions of the low bits."""
    differ = a ^ b
    differ = (differ | (differ >> np.uint64(1))) & np.uint64(0x5555555555555555)
    equal = 1 - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64) / HASHES
    chance = 0.5**LOW_BITS
    return (equal - chance) / (1 - chance)


def _possible(sig_a: np.ndarray, sig_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    sizes = 100 * np.minimum(size_a, size_b) >= PERCENT * np.maximum(size_a, size_b)
    return sizes & (estimate(sig_a, sig_b) >= LEAST_ESTIMATE)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups, from batches sorted by ``keys``."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        change = _changes([table.column(k).combine_chunks() for k in keys])
        if held and not all(held[-1].column(k)[-1].equals(table.column(k)[0]) for k in keys):
            yield pa.concat_tables(held)
            held = []
        last = int(change[-1]) if len(change) else 0
        if last:
            yield pa.concat_tables([*held, table.slice(0, last)])
            held = []
        held.append(table.slice(last))
    if held:
        yield pa.concat_tables(held)


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Positions at which a new group begins, without the first."""
    flag = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        x = c.to_numpy(zero_copy_only=False)
        flag |= x[1:] != x[:-1]
    return np.flatnonzero(flag) + 1


EDGES_DDL = "a long, b long"
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _spread(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowest labels over the pairs (a, b)."""
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _bucket_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a spanning forest of the possible pairs in each unit of a bucket, but those within a part."""
    for table in _grouped(batches, ["unit"]):
        n = table.num_rows
        group = np.zeros(n, np.int64)
        group[_changes([table.column("unit").combine_chunks()])] = 1
        group = np.cumsum(group)
        rep, part = table.column("rep").to_numpy(), table.column("part").to_numpy()
        at, found = np.arange(n), []
        sig, size = _signatures(table)
        for step in range(1, n):
            at = at[(at + step < n)]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            good = at[_possible(sig[at], sig[at + step], size[at], size[at + step]) & (part[at] != part[at + step])]
            if len(good):
                found.append(np.stack([good, good + step]))
        if not found:
            continue
        a, b = np.concatenate(found, axis=1)
        trees = _spread(np.arange(n), a, b)
        inner = np.flatnonzero(trees != np.arange(n))
        yield pa.RecordBatch.from_arrays([pa.array(rep[trees[inner]]), pa.array(rep[inner])], schema=EDGES)


def _to_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rep, leader): the first of a row's ``leaders`` that a link is possible with, or null."""
    for batch in batches:
        n = batch.num_rows
        sig, size = _signatures(batch)
        out, leaders = np.full(n, -1), batch.column("leaders")
        offsets, flat = leaders.offsets.to_numpy(), leaders.values
        mates = np.stack([flat.field(s).to_numpy() for s in SIGNATURE], axis=1).view(np.uint64)
        sizes = flat.field("size").to_numpy()
        for k in range(LEADERS):
            at = np.flatnonzero((out < 0) & (offsets[:-1] + k < offsets[1:]))
            mate = offsets[at] + k
            good = _possible(sig[at], mates[mate], size[at], sizes[mate])
            out[at[good]] = mate[good]
        found = pa.array(flat.field("rep").to_numpy()[np.maximum(out, 0)] if n else np.zeros(0, np.int64), mask=out < 0)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("rep"), found], names=["key", "rep", "leader"])


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each unit that may be linked with one of another part."""
    for table in _grouped(batches, ["unit"]):
        cutting = [0, *_changes([table.column("unit").combine_chunks()]).tolist(), table.num_rows]
        part = table.column("part").to_numpy()
        sig, size = _signatures(table)
        wanted = np.zeros(table.num_rows, bool)
        for begin, end in zip(cutting, cutting[1:], strict=False):
            for i in range(begin, end - 1):
                good = i + 1 + np.flatnonzero(_possible(sig[i], sig[i + 1 : end], size[i], size[i + 1 : end]) & (part[i] != part[i + 1 : end]))
                wanted[good] = True
                wanted[i] |= len(good) > 0
        yield from table.filter(pa.array(wanted)).combine_chunks().to_batches()


def _signatures(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([rows.column(s).to_numpy() for s in SIGNATURE], axis=1).view(np.uint64), rows.column("size").to_numpy()


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links within each unit: a spanning forest of the pairs that reach the threshold."""
    for table in _grouped(batches, ["unit"]):
        cutting = [0, *_changes([table.column("unit").combine_chunks()]).tolist(), table.num_rows]
        for begin, end in zip(cutting, cutting[1:], strict=False):
            if end - begin > 1:
                links = _confirm_unit(table.slice(begin, end - begin))
                if links:
                    a, b = zip(*links, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=EDGES)


def _confirm_unit(unit: pa.Table) -> list[tuple[int, int]]:
    rep = unit.column("rep").to_numpy()
    part = unit.column("part").to_numpy()
    sig = np.stack([unit.column(s).to_numpy() for s in SIGNATURE], axis=1).view(np.uint64)
    sets = [own for batch in unit.select(["text"]).to_batches() for part in text_slices(batch, "text") for own in _each_set(part.column("text"))]
    size = np.array(list(map(len, sets)))
    n = len(rep)
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.get(i, i) != i:
            root[i] = root.get(root[i], root[i])
            i = root[i]
        return i

    links, pairs, scores = [], [], []
    for i in range(n - 1):
        guess = estimate(sig[i], sig[i + 1 :])
        good = np.flatnonzero((guess >= LEAST_ESTIMATE) & (100 * np.minimum(size[i], size[i + 1 :]) >= PERCENT * np.maximum(size[i], size[i + 1 :])))
        pairs.append(np.stack([np.full(len(good), i), i + 1 + good], axis=1))
        scores.append(guess[good])
    pairs = np.concatenate(pairs)[np.argsort(-np.concatenate(scores), kind="stable")]
    for i, j in pairs.tolist():
        a, b = find(int(part[i])), find(int(part[j]))
        if a == b:
            continue
        x, y = sets[i], sets[j]
        place = np.searchsorted(x, y)
        both = int((x[np.minimum(place, len(x) - 1)] == y).sum())
        if 100 * both >= PERCENT * (len(x) + len(y) - both):
            root[max(a, b)] = min(a, b)
            links.append((int(rep[i]), int(rep[j])))
    return links


def _follow(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key. Keys that many of many rows share are
    broadcast; there are fewer than HEAVY of them."""
    total = rows.count()
    if total <= MANY_ROWS:
        return rows.join(table, key)
    often = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > total // HEAVY).select(key, F.lit(True).alias("_often"))
    often = materialise(often, "heavy")
    heavy = table.join(F.broadcast(often), key, "left_semi")
    marked = rows.join(F.broadcast(often), key, "left")
    own = marked.filter("_often").drop("_often").join(F.broadcast(heavy), key)
    return own.unionByName(marked.filter("_often IS NULL").drop("_often").join(table, key))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the smallest node that the links reach, for every node of ``edges`` (a, b). Each round
    sends every node to its smallest neighbour, four steps at once, and contracts the links accordingly, so
    that those left to do shrink from round to round."""
    ordered = lambda df: df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialise(ordered(edges), f"{name}-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        near = materialise(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), f"{name}-near")
        for _ in range(2):
            further = _follow(near, near.toDF("label", "far"), "label").select("node", F.col("far").alias("label"))
            near = release(near, materialise(further, f"{name}-near"))
        half = _follow(edges, near.toDF("a", "la"), "a").select("la", "b")
        half = materialise(half, f"{name}-half") if edges.count() > MANY_ROWS else half
        edges = release(edges, materialise(ordered(_follow(half, near.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))), f"{name}-edges"))
        release(half)
        if labels is None:
            labels = near
        else:
            # every label is a node of the links left, or has none left and stays
            step = near.toDF("label", "far")
            moved = _follow(labels, step, "label").select("node", F.col("far").alias("label"))
            labels = release(labels, materialise(moved.unionByName(labels.join(step, "label", "left_anti").select("node", "label")), f"{name}-labels"))
            release(near)
    return labels if labels is not None else edges.toDF("node", "label")


def _leaders(of: str) -> list:
    """Aggregates for the leaders of a group of column ``of``: the members with the smallest of LEADERS hashes."""
    return [F.min_by(of, F.xxhash64(of, F.lit(f"lead{k}"))).alias(f"lead{k}") for k in range(LEADERS)]


def _units(members: DataFrame, docs: DataFrame, n_members: int) -> DataFrame:
    """Exact links of ``members`` (rep, part, unit, size, signature), whose texts are fetched by rep."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    members = F.broadcast(members) if n_members <= BROADCAST_IDS else members
    rows = texts.join(members, "rep").select("unit", "rep", "part", *SIGNATURE, "text")
    return map_arrow(rows.repartition("unit").sortWithinPartitions("unit", "rep"), _confirm, EDGES_DDL)


def _dealt(key: str, salt: str, n: Column) -> Column:
    """One of ``n`` places for a row, by a hash of ``key``."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), n.cast("long")).cast("int")


def _meeting(rows: DataFrame, apart: str, n_apart: Column, n_all: Column, key: str, group: str) -> DataFrame:
    """``rows`` with ``unit`` such that each row with ``apart`` meets all rows of its ``group``, block by block."""
    as_all = rows.withColumn("y", _dealt(key, "all", n_all)).withColumn("x", F.explode(F.sequence(F.lit(0), n_apart - 1)))
    as_apart = rows.filter(apart).withColumn("x", _dealt(key, "apart", n_apart)).withColumn("y", F.explode(F.sequence(F.lit(0), n_all - 1)))
    return as_all.unionByName(as_apart).withColumn("unit", F.xxhash64(group, "x", "y"))


def _candidates(classes: DataFrame) -> DataFrame:
    """Links (a, b) whose components hold all classes that a band bucket shows to be possibly linked."""
    own = ["rep", F.col("n_shingles").alias("size"), *SIGNATURE]
    rows = classes.select(*own, F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("m"), *_leaders("rep")).filter("m > 1")
    buckets = materialise(buckets, "buckets")
    ids = F.array_distinct(F.array(*[f"lead{k}" for k in range(LEADERS)]))
    in_bucket = skew_safe_lookup(rows, buckets.select("key", "m"), ["key"], "m", classes.count() * BANDS).filter("m > 1")
    in_bucket = materialise(in_bucket, "in-bucket")
    few = in_bucket.filter(F.col("m") <= BLOCK).select(F.col("key").alias("unit"), "rep", F.col("rep").alias("part"), "size", *SIGNATURE)
    forest = map_arrow(few.repartition("unit").sortWithinPartitions("unit", "rep"), _bucket_forest, EDGES_DDL)
    large = buckets.filter(F.col("m") > BLOCK)
    if large.isEmpty():
        return forest

    # all members of a large bucket meet its leaders
    named = large.select("key", "m", F.explode(ids).alias("rep"))
    named = named.join(classes.select(*own), "rep").groupBy("key").agg(F.first("m").alias("m"), F.collect_set(F.struct("rep", "size", *SIGNATURE)).alias("leaders"))
    many = in_bucket.filter(F.col("m") > BLOCK).drop("m")
    led = skew_safe_lookup(many, named, ["key"], "m", classes.count() * BANDS).select("key", "rep", "size", *SIGNATURE, "leaders")
    found = materialise(map_arrow(led, _to_leaders, "key long, rep long, leader long"), "led")
    to_leader = found.filter("leader IS NOT NULL").select(F.col("rep").alias("a"), F.col("leader").alias("b"))
    first = large.select(F.explode(F.transform(ids, lambda x: F.struct(F.element_at(ids, 1).alias("a"), x.alias("b")))).alias("e")).select("e.*")
    forest = forest.union(to_leader).union(first)
    apart = found.filter("leader IS NULL").groupBy("key").agg(F.count("*").alias("apart"))
    apart = materialise(apart.join(large.select("key", "m"), "key"), "apart")
    if apart.isEmpty():
        return forest
    # what has no leader meets all of its bucket
    again = skew_safe_lookup(many, apart, ["key"], "m", classes.count() * BANDS).filter("apart IS NOT NULL")
    alone = found.filter("leader IS NULL").select("key", "rep", F.lit(True).alias("alone"))
    again = again.join(alone, ["key", "rep"], "left").withColumn("alone", F.coalesce("alone", F.lit(False)))
    again = materialise(again.withColumn("part", F.when(F.col("alone"), F.col("rep")).otherwise(F.lit(-(1 << 63)))), "again")
    half = BLOCK // 2
    meets = _meeting(again, "alone", F.ceil(F.col("apart") / half).cast("int"), F.ceil(F.col("m") / half).cast("int"), "rep", "key")
    meets = meets.select("unit", "rep", "part", "size", *SIGNATURE).distinct()
    return forest.union(map_arrow(meets.repartition("unit").sortWithinPartitions("unit", "rep"), _bucket_forest, EDGES_DDL))


def link_components(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, label) of the class representatives that are linked. ``classes`` has rep, n_shingles,
    signature and bands, one row a class."""
    classes = classes.filter(F.col("rep").isNotNull())
    groups = components(_candidates(classes), "candidates")
    n_members = groups.count()
    size = classes.select(F.col("rep").alias("node"), F.col("n_shingles").alias("size"), *SIGNATURE)
    member = materialise(groups.join(size, "node"), "members")
    sized = member.groupBy("label").agg(F.count("*").alias("m"), F.sum(8 * F.col("size")).alias("bytes"), *_leaders("node"))
    chunks = F.ceil(F.greatest(F.col("m") / UNIT, F.col("bytes") / UNIT_BYTES)).cast("long")
    sized = materialise(sized.withColumn("chunks", chunks), "sized")
    member = skew_safe_lookup(member, sized, ["label"], "m", n_members)
    leads = (F.col("chunks") > 1) & F.col("node").isin(*[F.col(f"lead{k}") for k in range(LEADERS)])
    own_chunk = F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("chunks"))
    dealt = member.withColumn("chunk", F.explode(F.when(leads, F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(own_chunk))))
    dealt = dealt.select(F.col("node").alias("rep"), F.col("node").alias("part"), F.xxhash64("label", "chunk").alias("unit"), *SIGNATURE)
    first = materialise(_units(dealt, docs, n_members), "links")
    if sized.filter("chunks > 1").isEmpty():
        return components(first, "linked")

    parts = components(first, "parts").select("node", F.col("label").alias("part"))
    inside = member.filter("chunks > 1").select("label", "node", "m", "bytes", "size", *SIGNATURE).join(parts, "node", "left")
    inside = materialise(inside.withColumn("part", F.coalesce("part", "node")), "large")
    by_part = inside.groupBy("label", "part").agg(F.count("*").alias("n"), F.sum(8 * F.col("size")).alias("b"))
    main = by_part.groupBy("label").agg(F.max(F.struct("n", F.col("part").alias("main"), "b")).alias("top"), F.sum("n").alias("n"), F.sum("b").alias("b"))
    apart = main.select("label", "top.main", (F.col("n") - F.col("top.n")).alias("apart"), (F.col("b") - F.col("top.b")).alias("apart_bytes"), "n")
    apart = materialise(apart.filter("apart > 0"), "apart")
    if apart.isEmpty():
        return components(first, "linked")
    # every member apart from the main part meets every member of its group
    inside = skew_safe_lookup(inside, apart, ["label"], "n", inside.count()).filter("apart IS NOT NULL")
    blocks = lambda n, b: F.ceil(F.greatest(F.col(n) / (UNIT // 2), F.col(b) / (UNIT_BYTES // 2))).cast("int")
    meets = _meeting(inside, "part <> main", blocks("apart", "apart_bytes"), blocks("m", "bytes"), "node", "label")
    meets = meets.select("unit", F.col("node").alias("rep"), "part", "size", *SIGNATURE).distinct()
    ddl = "unit long, rep long, part long, size long, " + ", ".join(f"{s} long" for s in SIGNATURE)
    meets = map_arrow(meets.repartition("unit").sortWithinPartitions("unit", "rep"), _involved, ddl)
    meets = materialise(meets, "meets")
    second = _units(meets, docs, meets.count())
    return components(first.union(second), "linked")


def near_duplicates(docs: DataFrame, sets: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; with ``sets`` also d0 and d1, which are equal
    for equal sets and null for empty ones."""
    features = materialise(featurise(docs), "features")
    some = features.filter(F.col("d0").isNotNull())
    classes = some.groupBy("d0", "d1").agg(
        F.min("doc_id").alias("rep"),
        F.count("*").alias("n"),
        F.min_by(F.struct("n_shingles", *SIGNATURE, "bands"), "doc_id").alias("own"),
    )
    classes = materialise(classes.select("d0", "d1", "n", "rep", "own.*"), "classes")
    linked = link_components(docs, classes)
    lookup = classes.select("d0", "d1", "rep", "n").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    lookup = lookup.filter((F.col("n") > 1) | F.col("label").isNotNull()).select("d0", "d1", "n", F.coalesce("label", "rep").alias("component"))
    rows = features.select("doc_id", "n_shingles", "d0", "d1")
    found = skew_safe_lookup(rows, lookup, ["d0", "d1"], "n", features.count())
    component = F.coalesce("component", "doc_id")
    also = ["d0", "d1"] if sets else []
    return found.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), *also)
