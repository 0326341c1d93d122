"""SimHash near-duplicates by exact, tiled comparison of all fingerprints.

Distinct fingerprints are dealt into tiles of one population count each. Two fingerprints within the
radius differ in population count by no more than the radius, so only such tile pairs meet; inside a
task numpy compares them block by block (exclusive-or, bit count), again leaving out blocks whose
counts in the lower 32 bits are too far apart. A task returns a spanning forest of the links it finds,
not the links, so a group of n near copies costs n rows and no link between classes is lost. Classes
come from alternating star contractions with checkpoints in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve.llm.common import free_names
from urlsieve.operators.lookups import lookup_join
from urlsieve.session import cut_lineage

RADIUS, SHINGLE, SEED = 4, 4, 42
BLOCK = 1024
EDGES = 1 << 18  # edges that a task contracts together, 4 MB
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over the word shingles of a whole text; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory on very long texts
        until = min(n, at + (1 << 16))
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[at:until].tolist(), last[at:until].tolist())],
                     dtype=np.uint64)
        counts += _bit_counts(h)
    bits = np.flatnonzero(2 * counts > n)
    return sum(1 << int(b) for b in bits)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each bit is set: eight byte lanes are added at once, 255 values before they overflow."""
    pad = -len(h) % 255
    if pad:
        h = np.concatenate([h, np.zeros(pad, np.uint64)])
    out = np.zeros((8, 8), np.int64)
    for j in range(8):
        lanes = ((h >> np.uint64(j)) & _LANES).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        out[:, j] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.reshape(64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``_key, _fp`` (signed long), ``_text_id`` per row; rows that repeat stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], ["_key", "_fp", "_text_id"])

    slim = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_text_id"))
    return slim.mapInArrow(run, "_key long, _fp long, _text_id long")


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x, root of x) of a spanning forest of the graph with edges (a, b), x != root."""
    names, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inverse[: len(a)], inverse[len(a):]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    x = np.flatnonzero(label != np.arange(len(names)))
    return names[x], names[label[x]]


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of all pairs from a x b within the radius."""
    low32 = np.uint64(0xFFFFFFFF)
    a = a[np.argsort(np.bitwise_count(a & low32), kind="stable")]
    b = b[np.argsort(np.bitwise_count(b & low32), kind="stable")]
    pa_, pb = (np.bitwise_count(x & low32).astype(np.int16) for x in (a, b))
    left, right, held = [], [], 0
    for at in range(0, len(a), BLOCK):
        x = a[at: at + BLOCK]
        lo = np.searchsorted(pb, pa_[at] - radius)
        hi = np.searchsorted(pb, pa_[min(at + BLOCK, len(a)) - 1] + radius, side="right")
        for to in range(lo, hi, 4 * BLOCK):
            y = b[to: min(hi, to + 4 * BLOCK)]
            i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            other = x[i] != y[j]
            if other.any():
                left.append(x[i][other])
                right.append(y[j][other])
                held += len(left[-1])
                if held > 1 << 20:  # keep the forest, forget the links
                    f, g = local_forest(np.concatenate(left), np.concatenate(right))
                    left, right, held = [f], [g], len(f)
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return local_forest(np.concatenate(left), np.concatenate(right))


def near_links(distinct: DataFrame, radius: int = RADIUS, groups: int = 24, most: int = 1 << 20) -> DataFrame:
    """``a, b`` (signed long): forest edges whose classes are those of all links of ``distinct._fp``.

    A tile holds one population count and about 1/groups of the fingerprints, ``most`` at the most, so
    a fingerprint is sent to a fixed number of tasks until the corpus passes groups * most of them.
    """
    spark = distinct.sparkSession
    pop = F.bit_count("_fp")
    base = distinct.select("_fp", pop.cast("int").alias("_p"))
    sizes = {r["_p"]: r["n"] for r in base.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    size = min(most, max(2048, math.ceil(sum(sizes.values()) / groups)))
    parts = {p: math.ceil(n / size) for p, n in sizes.items()}
    pairs = [(p, s, q, t) for p in parts for q in parts if p <= q <= p + radius
             for s in range(parts[p]) for t in range(parts[q]) if (p, s) <= (q, t)]
    if not pairs:
        return spark.createDataFrame([], "a long, b long")
    # the tile of a row, then the pairs of that tile: both small tables that grow with the square of N / most
    tiles = base.withColumn("_s", F.pmod(F.xxhash64("_fp"), _lookup(parts, "_p")).cast("int"))
    plan = spark.createDataFrame(
        [(p, s, i, 0) for i, (p, s, _, _) in enumerate(pairs)]
        + [(q, t, i, 1) for i, (p, s, q, t) in enumerate(pairs) if (p, s) != (q, t)],
        "_p int, _s int, _pair int, _side int")
    dealt = tiles.join(plan, ["_p", "_s"]).select("_pair", "_side", "_fp")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["_fp"].to_numpy().astype(np.uint64)
        side = rows["_side"].to_numpy()
        a = fp[side == 0]
        b = fp[side == 1] if (side == 1).any() else a
        x, y = tile_links(a, b, radius)
        return pd.DataFrame({"a": x.astype(np.int64), "b": y.astype(np.int64)})

    tasks = min(4000, max(len(pairs), spark.sparkContext.defaultParallelism))  # a number, so that it stays
    return dealt.repartition(tasks, "_pair").groupBy("_pair").applyInPandas(compare, "a long, b long")


def _lookup(numbers: dict[int, int], column: str):
    pairs = [F.lit(x) for kv in numbers.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.col(column))


def contracted(edges: DataFrame, parts: int, most: int = EDGES) -> DataFrame:
    """``u, v`` (u > v): edges with the classes of ``edges`` (u, v), a spanning forest for each block of them.

    A block is about ``most`` rows of one of ``parts`` partitions; roots are the smallest nodes of a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest() -> pa.RecordBatch:
            x, y = local_forest(np.concatenate([a for a, _ in block]), np.concatenate([b for _, b in block]))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["u", "v"])

        block, held = [], 0
        for batch in batches:
            block.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            held += batch.num_rows
            if held >= most:
                yield forest()
                block, held = [], 0
        if held:
            yield forest()

    return edges.coalesce(parts).mapInArrow(run, "u long, v long")


def _both_ways(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Two edges out of one row, without reading the rows twice."""
    return F.inline(F.array(*(F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in (a, b))))


def components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """``node, root`` for every node of an edge that is not the smallest it is connected to: that smallest node.

    Blocks of edges are contracted where they lie, then large-star and small-star steps link the blocks.
    It ends when every node has one neighbour or larger ones only, which is a minimum and a maximum per
    node. Both take map-side combination and each step is checkpointed, so a lost executor repeats one
    step. Tables between the steps have as many partitions as their rows fill, not as shuffles have:
    every task and every exchange costs the driver memory.
    """
    raw = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, math.ceil(raw.count() / most))
    here = cut_lineage(contracted(raw, parts, most))
    while True:
        both = here.select(_both_ways(("u", "v"), ("v", "u")))
        nodes = cut_lineage(both.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).coalesce(parts))
        if not nodes.where("lo < u AND lo < hi").count():
            return nodes.where("lo < u").select(F.col("u").alias("node"), F.col("lo").alias("root"))
        large = both.join(nodes.select("u", F.least("lo", "u").alias("m")), "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        after = large.join(small, "u").select(_both_ways(("v", "m"), ("u", "m"))).where("u <> v").distinct()
        here = cut_lineage(contracted(after, parts, most))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE,
) -> DataFrame:
    """``<key>, fingerprint`` (16 hex digits), ``component_id``, ``n_rows`` for every row of ``docs``.

    ``component_id`` is the smallest key reachable over links of at most ``radius`` differing bits. Null
    and blank texts have fingerprint zero and link like any other; a row with a null key belongs to its
    component but never names it (null where no row of the component has a key). Repeated rows stay.
    """
    return classified(docs, key, text, radius, shingle).select(
        F.col("_key").alias(key), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id", "n_rows")


def classified(docs: DataFrame, key: str, text: str, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``_key, _text_id, _fp, _root, component_id, n_rows`` per row; ``_root`` numbers the class."""
    rows = cut_lineage(fingerprints(docs, key, text, shingle))
    distinct = cut_lineage(rows.groupBy("_fp").agg(F.min("_key").alias("_least"), F.count("*").alias("_n")))
    roots = components(near_links(distinct, radius))
    named = distinct.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left").select(
        "_fp", F.coalesce("root", "_fp").alias("_root"), "_least", "_n")
    classes = named.groupBy("_root").agg(F.min("_least").alias("component_id"), F.sum("_n").alias("n_rows"))
    table = named.select("_fp", "_root").join(classes, "_root").select("_fp", "_root", "component_id", "n_rows")
    return rows.join(table, "_fp").select("_key", "_text_id", "_fp", "_root", "component_id", "n_rows")


def one_per_root(docs: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs``, one for each ``_root`` of ``rows`` (``_key, _text_id, _root``): that of the smallest
    key, then text hash.

    A document is its key and its text, so texts that share a key stay unless their classes have others.
    Rows equal in both are one document, of which any row stays. Rows with a null key cannot name a class
    and stay. Texts move only where the list of what goes outgrows a broadcast.
    """
    (pair,) = free_names(docs, "_pair")
    (state,) = free_names(docs, "_state")
    member = F.concat_ws(":", F.col("_key").cast("string"), F.hex("_text_id"))
    each = cut_lineage(rows.where(F.col("_key").isNotNull()).groupBy("_root", "_key", "_text_id").agg(F.count("*").alias("_n")))
    # map-side minima: a large class sends a row per task
    first = each.groupBy(F.col("_root").alias("_class")).agg(F.min(F.struct("_key", "_text_id")).alias("_first"))
    judged = lookup_join(each, first.withColumnRenamed("_class", "_root"), "_root").select(
        member.alias(pair), F.when(F.struct("_key", "_text_id") != F.col("_first"), "gone").when(F.col("_n") > 1, "many").alias(state))
    named = docs.withColumn(pair, F.when(F.col(key).isNotNull(), F.concat_ws(
        ":", F.col(key).cast("long").cast("string"), F.hex(F.xxhash64(text)))))
    met = lookup_join(named, judged.where(F.col(state).isNotNull()), pair)
    once = met.where(F.col(state) == "many").dropDuplicates([pair])
    return met.where(F.col(state).isNull()).unionByName(once).select(*docs.columns)


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, one for each class of linked fingerprints; see :func:`one_per_root` for ties."""
    return one_per_root(docs, classified(docs, key, text, **how), key, text)
